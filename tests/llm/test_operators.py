"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.llm import ann, html_text, jaccard, langid, line_dedup, lm_score, mixing, pii, queries, token_output
from geofeat.llm import decontaminate as decon
from geofeat.llm.common import held_out
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", ".", ","]) for _ in range(400)]
    texts = [sentence(rng, rng.randint(1, 120), words) for _ in range(60)]
    for k in range(12):  # near copies
        w = texts[k].split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], "", "   ", "\n\n", None, "a", "a b", "A  B", "a\tb", "x" * 50_000, " lead", "trail ", "a \n b", "a\n \nb", "tab\t\tx", "<|endoftext|> end", "它 世界 hello", "it's we'll 12ab3 ---"]
    texts += [sentence(rng, 3000, words)]
    return [(k, t, None if k % 9 == 0 else "xx", f"s{k % 3 if k % 2 else 0}", len(t or ""), "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files_equal_the_library(docs, rows, empty):
    path = queries.tokenizer_path()
    got = [tuple(r) for r in token_output.token_output(docs, path, length=64).collect()]
    assert sorted(got) == brute.tokens([r[:2] for r in rows], path)
    assert token_output.token_output(empty, path).count() == 0


def test_token_sequences_are_found_at_random(spark, docs):
    import tempfile

    folder = "file://" + tempfile.mkdtemp(prefix="tokens-")
    manifest = token_output.write_tokens(docs, queries.tokenizer_path(), folder, length=32, rows=4).collect()
    for shard in manifest:
        reader = token_output.open_file(shard["ids_path"])
        whole = np.concatenate([reader.get_batch(k).column("ids").flatten().to_numpy() for k in range(reader.num_record_batches)])
        assert len(whole) == shard["n_sequences"] * 32
        for k in {0, shard["n_sequences"] // 2, shard["n_sequences"] - 1}:
            ids, mask = token_output.sequence(reader, k, 4)
            assert (ids == whole[k * 32 : k * 32 + 32]).all()
            assert mask.sum() == min(32, shard["n_ids"] - k * 32)
        assert all(reader.get_batch(k).num_rows == 4 for k in range(reader.num_record_batches - 1))
        with pytest.raises(IndexError):
            token_output.sequence(reader, shard["n_sequences"], 4)


def test_other_tokenizers_are_encoded_whole(tmp_path):
    import json

    path = queries.tokenizer_path()
    spec = json.load(open(path, encoding="utf-8"))
    assert token_output.plain_byte_level(path)
    spec["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert not token_output.plain_byte_level(str(other))
    coder = token_output.UnitEncoder(str(other))
    assert np.frombuffer(coder.encode("Hello WORLD"), coder.dtype).tolist() == coder.tokenizer.encode("Hello WORLD", add_special_tokens=False).ids


@pytest.mark.parametrize("n,percent,small", [(4, 85, 100), (4, 85, 20), (5, 80, 40)])
def test_jaccard_components(docs, rows, n, percent, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, n, percent, small=small).collect()}
    assert got == brute.components([r[:2] for r in rows], n, percent)


def test_jaccard_of_nothing(empty):
    assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_chains(spark):
    """A chain of texts, each linked to the next only."""
    rng = random.Random(3)
    w = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(12):
        texts.append((100 - k, " ".join(w)))
        w[rng.randrange(5, 55)] = f"new{k}"
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in brute.components(texts).items()}


def test_decontamination(spark, docs, rows):
    items = [(str(k), " ".join((rows[k][1] or "").split()[2:25])) for k in range(0, 50, 3)] + [("s", "a b"), ("n", None), ("e", "..."), (None, rows[1][1]), ("z", "never seen words at all")]
    items.append(items[0][:1] + (items[1][1],))
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination([r[:2] for r in rows], items)
    for block in (32 << 20, 300):
        got = decon.decontaminate(docs, bench, block_bytes=block).collect()
        for r in got:
            hit = sum(s["end"] - s["first"] for s in r["spans"])
            assert (r["n_words"], hit, len(r["items"]), decon.digest(r["items"]), hit > 0) == want[r["doc_id"]]
    assert decon.decontaminate(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    clash = docs.withColumnsRenamed({"lang": "n_words", "source": "items"})
    kept = decon.decontaminate(clash, bench, keep=("n_words", "spans", "items"), prefix="hit_")
    assert kept.columns == ["doc_id", "text", "n_words", "spans", "items", "hit_n_words", "hit_spans", "hit_items"] and kept.filter("spans = 'clash'").count() == len(rows)
    assert decon.decontaminate(clash, bench, keep=("n_words", "spans", "items")).columns == ["doc_id", "text", "n_words", "spans", "items"]


def test_benchmark_windows_stay_small():
    """Arrays hold less than 120 bytes a window, so that a block of 16 MB keeps to a few hundred MB."""
    import pickle

    import pyarrow as pa

    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    texts = pa.array([sentence(rng, 300, words) for _ in range(300)])
    made = decon.Windows(pa.array([str(k) for k in range(300)]), texts, 10)
    assert len(pickle.dumps(made)) < 60 * len(made.lengths)


def test_cut_spans(spark):
    d = spark.createDataFrame([(1, "Keep, the one two three: end.")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    assert decon.cut_spans(decon.decontaminate(d, b)).head()["text"] == "Keep, the : end."


def test_language_id(spark):
    rng = random.Random(5)
    langs = {"en": "the and of with from that this".split(), "de": "der die und nicht für sich über".split(), "fr": "le les dans pour être où".split()}
    train = [(k, sentence(rng, 40, w), x) for k, (x, w) in enumerate(list(langs.items()) * 10)]
    test = [(1000 + k, sentence(rng, 15, w), x) for k, (x, w) in enumerate(langs.items())]
    odd = [(2000, None, None), (2001, "123 456 !! ½ ² Ⅷ", None), (2002, "", None), (2004, "½", None), (2003, sentence(rng, 20, langs["en"]) + " " + sentence(rng, 60, langs["de"]), "de")]
    d = spark.createDataFrame(train + test + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d, spark.createDataFrame(train, d.schema)).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in test) and got[2003]["lang_pred"] == "de"
    assert len(got[2003]["langs"]) == 2 and 0.5 < got[2003]["score"] < 1
    assert {got[k]["lang_pred"] for k in (2000, 2001, 2002, 2004)} == {"und"} and got[2000]["score"] == 0
    none = langid.identify(d, d.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_mixture_inference_against_plain_em():
    """Proportions of many texts at once against EM and backward elimination of one text at a time."""
    rng = np.random.default_rng(3)

    def em(ll):
        pi = np.full(ll.shape[1], 1 / ll.shape[1])
        for _ in range(400):
            joint = np.exp(ll) * pi
            pi = (joint / joint.sum(1, keepdims=True)).mean(0)
        return pi, np.log((np.exp(ll) * pi).sum(1)).sum()

    texts = []
    for k in range(30):
        ll = -rng.gamma(0.5, 6, (int(rng.integers(1, 60)), 4))
        ll[:, k % 4] *= 0.05 if k % 3 else 0.4
        texts.append(ll - ll.max(1, keepdims=True))
    sizes = np.array([len(x) for x in texts])
    got = langid.infer(np.concatenate(texts).T.astype(np.float32), np.cumsum(sizes) - sizes, 2.0)
    for ll, pi in zip(texts, got.T):
        cost, kept = 2.0 * max(1, np.log(len(ll))), [0, 1, 2, 3]
        p, value = em(ll)
        while len(kept) > 1:
            rest = [x for j, x in enumerate(kept) if j != p.argmin()]
            q, less = em(ll[:, rest])
            if value - less > cost:
                break
            kept, p, value = rest, q, less
        want = np.zeros(4)
        want[kept] = p
        assert pi == pytest.approx(want, abs=0.05) and pi.sum() == pytest.approx(1)


def test_language_id_on_held_out_documents(spark):
    """Accuracy of the registered query on documents it has not learned from, against the given labels."""
    sf = "/root/testdata/sf0.01"
    out = queries.op10_language_id(spark, sf).filter("held_out")
    labels = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    right, n = out.join(labels, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 100 and right / n > 0.98


PII = [
    "mail a.b@c.de, x@y, a@b@c.d and a@b.com_x@y.z... q@w.e..r@t.y.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.02.03.004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 1111 79927398713 5500000000000004",
    "+49 (30) 123456-78 +1 23 ++44 20 7946 0958 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 but DE89370400440532013001",
    "é" * 30 + " ü@x.com z@x.com " + "1" * 3000 + " " + "1-" * 3000 + "1",
    "",
    None,
]


def test_pii(spark):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(PII)], "doc_id long, text string, email string")
    found = pii.find_pii(d)
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.joined("email", "ip", "card", "phone").alias("s")).collect()}
    assert got == {k: ",".join(brute.pii(t)) for k, t in enumerate(PII)}
    ibans = {r["doc_id"]: r["iban"] for r in found.select("doc_id", "iban").collect()}
    assert [(x["start"], x["end"], x["score"]) for x in ibans[4]] == [(5, 32, 1.0), (36, 58, 1.0)]
    near = spark.createDataFrame([(1, "call +4930123456 or 1.2.3.4 now"), (2, "x" * 60 + " +4930123456")], "doc_id long, text string")
    scored = {r["doc_id"]: r["s"] for r in pii.find_pii(near).select("doc_id", pii.scores("ip", "phone").alias("s")).collect()}
    assert scored == {1: "0.60,0.80", 2: "0.60"}


def test_line_dedup(spark):
    line = "All rights are reserved here."
    d = spark.createDataFrame([(k, f"own text of document {k}\n{line}\nshort\n", f"s{k % 6}") for k in range(12)] + [(50, None, "s1"), (51, "", None), (52, line, None), (52, line, None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(d, min_sites=5).collect()}
    assert got[3]["text"] == "own text of document 3\nshort\n" and (got[3]["n_lines"], got[3]["n_removed"]) == (4, 1)
    assert got[50]["text"] is None and got[50]["n_lines"] == 0 and got[52]["text"] == ""
    assert line_dedup.line_dedup(d.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(k, "w " * rng.randint(0, 40) or None, "big" if k % 5 else f"s{k % 3}", 1) for k in range(400)], "doc_id long, text string, source string, tokens int")
    got = mixing.mix(d, repetition=1.5, bucket_docs=16, block_tokens=500).collect()
    total, count = {}, {}
    for r in got:
        total[r["source"]] = total.get(r["source"], 0) + r["tokens"]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert len(count) == 400 and max(count.values()) <= 2
    size = {}
    for r in got:
        size.setdefault(r["source"], {})[r["doc_id"]] = r["tokens"]
    repeats = {s: total[s] / sum(v.values()) for s, v in size.items()}
    assert repeats["big"] < 1.02 and max(repeats.values()) < 1.7
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())
    assert mixing.mix(d.limit(0), repetition=1.5).count() == 0


def test_mixed_documents_keep_sources_and_take_a_seed(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "c", None), (None, None, "x")], "doc_id long, text string, source string")
    for seed in (5, 17):
        got = mixing.mixed_documents(d, seed=seed, repetition=1.0).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in d.collect()}


def test_exponent_meets_the_target(spark):
    s = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1)], "source string, tokens long, docs long")
    a = mixing.bisect_exponent(s, entropy=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** a
    p /= p.sum()
    assert -(p * np.log(p)).sum() / math.log(3) == pytest.approx(0.8, abs=1e-6)
    assert mixing.bisect_exponent(s, repetition=3.0) == pytest.approx(1 - math.log(3) / math.log(90), abs=1e-6)


def test_lm_score(docs, rows):
    got = {r["doc_id"]: r for r in lm_score.score(docs, held_out(F.col("doc_id"), 7, 2), block_bytes=4096).collect()}
    tok = {d: re.findall("[^\x20\x09-\x0d]+", brute.fold(t)) + [None] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tok}
    c = {}
    for d, w in tok.items():
        if not held[d]:
            for x in w:
                c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    for d, w in tok.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_score_predicts_from_earlier_words(spark):
    """Two held-out texts of equally frequent words: the one in the order of the training texts scores higher."""
    rows = [(k, "red apple" if k % 2 else "old house") for k in range(200)] + [(1000, "red apple"), (1001, "red house")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(d, F.col("doc_id") >= 1000).filter("held_out").collect()}
    assert got[1000] > got[1001] + 1


def test_lm_score_falls_when_order_is_lost(spark):
    """Held-out texts of the training texts' kind score clearly higher than the same words shuffled."""
    rng = random.Random(8)
    follow = {w: rng.sample("ba de fi go hu ka le mi no pu".split(), 2) for w in "ba de fi go hu ka le mi no pu".split()}

    def text():
        w = [rng.choice(list(follow))]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        return w

    rows = [(k, " ".join(text())) for k in range(300)]
    for k in range(20):
        w = text()
        rows += [(1000 + k, " ".join(w)), (2000 + k, " ".join(rng.sample(w, len(w))))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(d, F.col("doc_id") >= 1000).filter("held_out").collect()}
    mean = lambda lo: sum(got[lo + k]["bits_per_byte"] for k in range(20)) / 20
    assert mean(1000) < 0.85 * mean(2000)
    assert all(got[1000 + k]["base_score"] == pytest.approx(got[2000 + k]["base_score"]) for k in range(20))


def test_mixer_counts_keep_their_ratio(spark):
    """Counts of any size stay in proportion, small ones exactly, and the tables grow with the vocabulary."""
    n = np.array([0, 1, 7, 31, 32, 189_164, 283_015, 10**9, 10**13])
    back = lm_score._CODED[lm_score.code(n)]
    assert (back[:5] == n[:5]).all() and np.allclose(back[5:] / n[5:], 1, atol=0.07)
    cells = np.zeros((2, 16), np.int64)
    cells[0, [3, 9, 12]] = 5, 2, 1
    pairs = lm_score.coded(cells)
    assert [(int(x) & 255, int(x) >> 8) for x in (pairs[0, 1], pairs[0, 2], pairs[0, 3], pairs[0, 4 + 2])] == [(5, 3), (5, 0), (2, 1), (2, 0)]
    assert not pairs[1].any()
    assert lm_score.row_bits(100) < lm_score.row_bits(50_000) < lm_score.row_bits(400_000)
    d = spark.createDataFrame([("xaxaxaxbxb" * 30_000, False)], "text string, held_out boolean")
    first = lm_score._table_counts(d, 300_000, 12)[0].reshape(-1)
    codes = sorted({int(c) for x in first for c in (x & 255, x >> 8)})
    assert any(abs(lm_score._CODED[c] / 90_000 - 1) < 0.07 for c in codes) and any(abs(lm_score._CODED[c] / 60_000 - 1) < 0.07 for c in codes)


def plain_mixer(train, text):
    """log10 of each byte of a held-out text by dictionaries of counts, bit by bit, with the first weights."""
    contexts = lambda t, k, a: [(n, t[max(a, k - n) : k]) for n in lm_score.ORDERS] + [("w", t[max(a, t.rfind(b" ", a, k) + 1) : k])]
    counts = {}
    for t in train:
        for k in range(len(t)):
            for c in contexts(t, k, 0):
                counts.setdefault(c, {}).setdefault(t[k], 0)
                counts[c][t[k]] += 1
    known, out = lm_score._CODED, []
    near = lambda n: known[lm_score.code(np.array([n]))[0]]
    for k in range(len(text)):
        p = 1.0
        for j in range(8):
            z = 0.0
            for c in contexts(text, k, 0):
                seen = {b: n for b, n in counts.get(c, {}).items() if b >> (8 - j) == text[k] >> (8 - j)}
                one = sum(n for b, n in seen.items() if b >> (7 - j) & 1)
                z += 0.3 * (math.log(near(one) + 0.4) - math.log(near(sum(seen.values()) - one) + 0.4))
            z, places = max(-8, min(8, z)), np.linspace(-8, 8, 33)
            one = (1 / (1 + math.exp(-z)) + np.interp(z, places, 1 / (1 + np.exp(-places)))) / 2
            p *= one if text[k] >> (7 - j) & 1 else 1 - one
        out.append(math.log10(p))
    return out


def test_mixer_against_dictionaries():
    """Hashed and coded tables give what plain dictionaries give (first weights, refining map at rest)."""
    train = [b"blue tree far river \n", b"far tree blue sky \n", b"a far blue river was blue \n"]
    text = b"far blue tree was blue \n"
    bits = 18  # enough rows that no two of these contexts share one
    sums = np.zeros((lm_score.CONTEXTS, 16 << bits), np.int32)
    for t in train:
        raw = np.frombuffer(t[:-2], np.uint8)
        got, doc, unit, start = lm_score.running_text(raw, np.array([0, len(raw)]))
        assert got.tobytes() == t
        high = (got >> 4).astype(np.int64)
        for o, c in enumerate(lm_score.contexts_of(*lm_score.histories(got, doc, unit, start))):
            np.add.at(sums[o], (lm_score._rows(c, np.zeros(1, np.uint64), bits) << 4) + high, 1)
            np.add.at(sums[o], (lm_score._rows(c, high.astype(np.uint64) + np.uint64(1), bits) << 4) + (got & 15), 1)
    m = lm_score.Mixer(np.stack([lm_score.coded(x.reshape(-1, 16)) for x in sums]))
    raw = np.frombuffer(text[:-2], np.uint8)
    units = m.units([(raw, np.array([0, len(raw)]), np.array([False]))])[0]
    want = plain_mixer(train, text)
    spans = [(0, 4), (4, 9), (9, 14), (14, 18), (18, 23), (23, 24)]
    assert units == pytest.approx([sum(want[a:b]) for a, b in spans], rel=0.01)


def test_lm_score_of_nothing(empty):
    assert lm_score.score(empty, held_out(F.col("doc_id"), 7, 2)).count() == 0


def test_mixer_is_a_distribution():
    """Over all bytes after a context the bit predictions multiply to 1."""
    m = lm_score.Mixer(lm_score.coded(np.random.default_rng(0).integers(0, 5, (lm_score.CONTEXTS << 12, 16))).reshape(lm_score.CONTEXTS, -1, 16))
    text = np.arange(256, dtype=np.uint8)
    contexts = [np.full(256, 12345 + k, np.uint64) for k in range(lm_score.CONTEXTS)]
    own = np.zeros(256, bool)
    for _ in range(3):
        assert (10.0 ** m.log10(text, contexts, own)).sum() == pytest.approx(1, abs=1e-5)
        m.learn(text, contexts, own, np.full(256, 50))
        m.use(m.learned())


def test_all_training_texts_teach(spark):
    """Every byte of the training texts is learned from, over one block or several; held-out ones teach nothing."""
    rows = [(k, f"text {k} " + "ab cd " * (k % 5), k % 4 == 0) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    told = spark.sparkContext.broadcast(lm_score.Mixer(np.zeros((lm_score.CONTEXTS, 1 << 12, 16), np.uint16)))
    many = sum(len(t.split()) + len("".join(t.split())) + 1 for _, t, held in rows if not held)
    for lesson_bytes in (1 << 20, 100):
        sums = lm_score._lessons(d, told, lesson_bytes)
        _, seen, _ = np.split(sums, np.cumsum([told.value.weights.size, told.value.seen.size]))
        assert seen.reshape(8, -1).sum(1).tolist() == [many] * 8


def test_mixer_learns_what_helps():
    """Online learning raises the score of the texts it saw; lessons of two blocks add up to their mean, whatever their order."""
    rng = np.random.default_rng(1)
    raw = np.frombuffer((" ".join(rng.choice(["red", "apple", "old", "house", "by"], 900)) + " ").encode(), np.uint8)
    piece = (raw, np.array([0, len(raw)]), np.array([True]))
    alike, _ = lm_score.gathered([piece])
    assert alike.times.sum() == len(raw) + 1 and len(alike.text) < len(raw) / 5  # the text, its end
    sums = np.zeros((lm_score.CONTEXTS, 16 << 12), np.int64)
    high = (alike.text >> 4).astype(np.int64)
    for o, c in enumerate(alike.contexts()):
        np.add.at(sums[o], (lm_score._rows(c, np.zeros(1, np.uint64), 12) << 4) + high, alike.times.astype(int))
        np.add.at(sums[o], (lm_score._rows(c, high.astype(np.uint64) + np.uint64(1), 12) << 4) + (alike.text & 15), alike.times.astype(int))
    m = lm_score.Mixer(np.stack([lm_score.coded(x.reshape(-1, 16)) for x in sums]))
    before = m.units([piece])[0].sum()
    m.learn(alike.text, alike.contexts(), alike.own, alike.times)
    one = m.learned()
    m.use(one)
    assert m.units([piece])[0].sum() > before
    used = m.used.copy()
    m.use(one + one)
    assert np.allclose(m.used, used, atol=1e-5)


def test_caches_against_a_plain_loop():
    rng = np.random.default_rng(2)
    sizes = [0, 7, 1, 0, 30]
    first = np.concatenate([[0], np.cumsum(sizes)])
    word = rng.integers(0, 4, first[-1])
    spelled, ends = -rng.random(first[-1]) * 6, -rng.random(len(sizes)) * 3
    turn = np.concatenate([np.arange(n) for n in sizes])
    before = np.array([(word[a:k] == word[k]).sum() for a, b in zip(first, first[1:]) for k in range(a, b)])
    got, got_end = lm_score.with_caches(spelled, ends, before, turn, first, 10.0)
    for t, (a, b) in enumerate(zip(first, first[1:])):
        trust = [1.0] * len(lm_score.SHARES)
        for k in range(a, b):
            held = [s * turn[k] / (turn[k] + 10) for s in lm_score.SHARES]
            p = [(1 - h) * 10 ** spelled[k] + h * before[k] / max(turn[k], 1) for h in held]
            assert 10 ** got[k] == pytest.approx(sum(x * w for x, w in zip(p, trust)) / sum(trust))
            trust = [x * w for x, w in zip(p, trust)]
        p = [(1 - s * (b - a) / (b - a + 10)) * 10 ** ends[t] for s in lm_score.SHARES]
        assert 10 ** got_end[t] == pytest.approx(sum(x * w for x, w in zip(p, trust)) / sum(trust))


def test_blocks_are_scored_in_parts():
    """Units score what their bytes do one by one; a block's memory is little beside its text, whichever words it holds."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(chr(97 + int(c)) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 12, 40_000)] + ["x" * 600, "a\0", "a"])
    texts = [" ".join(rng.choice(vocabulary, 6000)).encode() for _ in range(192)] + [b"", b" ", vocabulary[0].encode()]
    pieces = []
    for a in range(0, len(texts), 24):
        part = texts[a : a + 24]
        pieces.append((np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(t) for t in part]), rng.integers(0, 2, len(part)) == 1))
    m = lm_score.Mixer(lm_score.coded(rng.integers(0, 5, (lm_score.CONTEXTS << 12, 16))).reshape(lm_score.CONTEXTS, -1, 16))
    tracemalloc.start()
    got = m.units(pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(map(len, texts))
    for (folded, off, own), scores in list(zip(pieces, got, strict=True))[-2:]:
        text, doc, unit, start = lm_score.running_text(folded, off)
        plain = m.log10(text, lm_score.contexts_of(*lm_score.histories(text, doc, unit, start)), own[doc])
        assert scores == pytest.approx(np.add.reduceat(plain, start, dtype=np.float64), rel=1e-4)


def test_lm_score_hangs_on_training_texts_and_the_text_alone(spark):
    """Other held-out texts, blocks and slices change no score."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    train = [(k, text(40)) for k in range(60)]
    long = [(100 + k, text(180_000)) for k in range(3)]  # several slices of one block
    short = [(200 + k, text(30)) for k in range(10)]
    score = lambda rows, **p: {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, **p).collect()}
    one = score(train + long + short)
    changed = score(train + [(100, "zq " * 300_000)] + long[1:] + short)
    blocks = score(train + short, block_bytes=2000)
    for k in [r[0] for r in train + short]:
        assert one[k] == pytest.approx(changed[k], rel=1e-5) and one[k] == pytest.approx(blocks[k], rel=1e-5)
    assert one[101] == pytest.approx(changed[101], rel=1e-5) and one[102] == pytest.approx(changed[102], rel=1e-5) and one[100] != changed[100]


def test_lm_score_of_nulls_and_repeats(spark):
    rows = [(None, "red apple", 1), (1, "red apple", 1), (1, "red apple", 1), (2, None, 1), (3, "", 1)] + [(k, "red old apple house", 1) for k in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = lm_score.score(d, held_out(F.col("doc_id"), 7, 2)).collect()
    assert len(got) == len(rows) and {type(r["score"]) for r in got} == {float}
    one = [r["score"] for r in got if r["doc_id"] == 1]
    assert len(one) == 2 and one[0] == one[1]
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (2, 3))


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).round(3)
    x[700:760] = x[0]
    rows = [(int(k), [float(v) for v in x[k]], 0) for k in range(1500)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [1.0] * 3, 0), (5300, [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in ann.search(d, F.col("vec_id") % 100 == 0, pack_rows=50, query_rows=4, shortlist=100, books=6, words=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        gap[q] = np.inf
        best = np.lexsort((np.arange(1500), gap))[:10]
        hit += len(set(best) & {v for v, _ in found.values()})
        assert all(s == pytest.approx(gap[v], abs=1e-12) for v, s in found.values())
    assert hit >= 0.9 * 10 * len(got)
    assert [got[0][k][0] for k in range(1, 11)] == list(range(700, 710))
    assert ann.search(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li>Home<li>News</ul></nav><header><h2>Site</h2></header><div class="ad">Buy now</div><aside>side</aside>
<article><header><h1>Title &amp; more</h1></header><p>First<br>line &lt;b&gt;</p><div class="share-bar">share</div><p>Second <b>bold</b><p>Third
 part<form>no</form><!-- gone --><section class="comments"><p>nice!</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    menu = "<div>One two three four five six seven eight nine ten</div>"
    plain = [(k, "http://h.example/" + str(k), f"<html><body>{menu}<p>alpha{k} beta{k} own words</p></body></html>", 1) for k in range(10, 16)]
    d = spark.createDataFrame([(1, "http://a.example/x", PAGE, 1), (2, None, None, 1), (3, "http://a.example/y", "", 1), (4, "u", "<p>a<p>b &amp c<div", 1), (4, "u", "plain", 1), *plain], "page_id long, url string, html string, text int")
    got = {}
    for r in html_text.extract(d).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == ["Title & more\n\nFirst line <b>\n\nSecond bold\n\nThird part"]
    assert got[2] == [""] and got[3] == [""] and sorted(got[4]) == ["a\n\nb & c", "plain"]
    assert all(got[k] == [f"alpha{k} beta{k} own words"] for k in range(10, 16))


def test_html_extraction_counts_over_the_shards_of_a_host(spark):
    menu = "<div>One two three four five six seven eight nine ten</div>"
    page = lambda k: f"<html><body>{menu if k % 4 else ''}<p>own{k} words{k}</p><p>{' '.join(f'w{k % 7}x{j}' for j in range(12))}</p></body></html>"
    rows = [(k, f"http://{'big' if k < 30 else 'small'}.example/{k}", page(k)) for k in range(36)]
    rows += [(40 + k, "http://marked.example/" + str(k), f"<article><p>text{k}</p></article>{menu}") for k in range(9)]
    rows += [(None, "http://big.example/n", None), (None, "http://big.example/n", None), (50, "http://big.example/e", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda **k: sorted((r["page_id"] or -1, r["text"]) for r in html_text.extract(d, **k).collect())
    whole, parts = texts(), texts(shard_pages=2)
    assert whole == parts and len(whole) == len(rows)
    assert dict(whole)[5] == "own5 words5" and dict(whole)[41] == "text1"


def test_html_extraction_gives_all_columns_alike_however_a_host_is_dealt(spark):
    menu = "<div>One two three four five six seven eight nine ten</div>"
    rows = [(k, f"http://{'marked' if k < 20 else 'mixed'}.example/{k}", f"<article><p>text{k} one two three four five six seven eight</p></article>{menu}") for k in range(30)]
    rows += [(30 + k, f"http://mixed.example/p{k}", f"<p>own{k}</p>{menu}") for k in range(10)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    all_columns = lambda **k: sorted(tuple(r) for r in html_text.extract(d, **k).collect())
    whole = all_columns()
    assert whole == all_columns(shard_pages=2) and {r[0]: r[-1] for r in whole} == {k: 0 if k < 30 else 10 for k in range(40)}


def test_html_extraction_of_empty_and_clashing_tables(spark):
    d = spark.createDataFrame([(k, "http://h.example/x", "<p>a b", k, "x", "y") for k in range(5)], "page_id long, url string, html string, shard int, host string, packed string")
    assert html_text.extract(d.filter("false")).collect() == []
    assert {r["text"] for r in html_text.extract(d, shard_pages=1).collect()} == {"a b"}


def test_repeated_substrings_against_all_windows():
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 3, n) for n in (40, 60, 5, 80)]
    where = {}
    for p, s in enumerate(streams):
        for k in range(len(s) - 4):
            where.setdefault(tuple(s[k : k + 5]), set()).add(p)
    for s, got in zip(streams, html_text.repeated(streams, 5, 3)):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 4):
            if len(where[tuple(s[k : k + 5])]) >= 3:
                want[k : k + 5] = True
        assert (want == got).all()


def test_digest():
    assert decon.digest(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()


@pytest.mark.parametrize("scale", [1e25, 1e200, 1e-30])
def test_ann_of_any_scale(spark, scale):
    """Finite vectors of any size are searched; distances that overflow are taken in scaled form."""
    x = np.random.default_rng(8).normal(size=(30, 8)) * scale
    d = spark.createDataFrame([(k * 50, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(d, F.col("vec_id") % 500 == 0, books=4, words=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [0, 500, 1000]
    for q, found in got.items():
        gap = np.sqrt((((x - x[q // 50]) / scale) ** 2).sum(1)) * scale
        gap[q // 50] = np.inf
        best = np.argsort(gap)[:10]
        assert [found[k][0] for k in range(1, 11)] == [int(b) * 50 for b in best]
        assert [found[k][1] for k in range(1, 11)] == [pytest.approx(gap[b], rel=1e-12) for b in best]


def test_ann_of_repeated_ids_and_clashing_columns(spark):
    """Each row of a repeated id is a query and a candidate of its own; only the row itself is left out."""
    rows = [(0, [1.0, 0.0], "x", 1.0), (0, [0.0, 1.0], "x", 1.0), (7, [1.0, 0.1], "x", 1.0), (8, [0.1, 1.0], "x", 1.0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score double")
    first = sorted(r["vec_id"] for r in ann.search(d, F.col("vec_id") % 100 == 0, k=1, books=2, words=4).collect())
    assert first == [7, 8]
    gaps = sorted(r["score"] for r in ann.search(d, F.col("vec_id") % 100 == 0, k=3, books=2, words=4).collect())
    want = sorted(math.dist(a[1], b[1]) for i, a in enumerate(rows[:2]) for j, b in enumerate(rows) if i != j)
    assert gaps == [pytest.approx(w) for w in want]


def test_ann_over_many_packs(spark):
    """20,000 vectors in three shares of packs and four groups of queries: recall at 10 of 0.9 and more."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16)) * 0.3).astype(np.float32)
    d = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.search(d, F.col("vec_id") % 100 == 0, pack_rows=100, query_rows=50, share_rows=7000, shortlist=200, sample=2048, books=8, words=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        gap = ((x - x[q]) ** 2).sum(1)
        gap[q] = np.inf
        hit += len(found & set(np.argsort(gap)[:10].tolist()))
    assert len(got) == 200 and hit >= 0.9 * 2000


def test_language_id_is_the_same_in_any_partitions(spark):
    """A text's result does not hang on the texts that share its slice or task."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(signs) for _ in range(rng.randint(2, 7))) for _ in range(60)] for lang, signs in (("a", "abcde"), ("b", "defgh"), ("c", "ghijk"))}
    mixed = [(k, " ".join(rng.choice(words[rng.choice("abc"[: 1 + k % 3])]) for _ in range(rng.randint(1, 80))), "abc"[k % 3] if k % 4 else None) for k in range(300)]
    d = spark.createDataFrame(mixed, "doc_id long, text string, lang string")
    one, many = (sorted(map(repr, langid.identify(d.repartition(n), d).drop("langs").collect())) for n in (1, 32))
    assert one == many


def test_language_id_keeps_clashing_columns(spark):
    d = spark.createDataFrame([(1, "ab cd", "x", -5.0, "mine")], "doc_id long, text string, lang string, score double, langs string")
    row = langid.identify(d, d, prefix="p_").head()
    assert (row["score"], row["langs"], row["p_lang_pred"]) == (-5.0, "mine", "x")
