"""The registered queries on the smallest tables, against plain versions of what they return."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from geofeat.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
words = lambda t: [w for w in brute.fold(t).translate(dict.fromkeys(range(9, 14), 32)).split(" ") if w]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return [(d, t) for d, t in table("documents", "doc_id, text")]


def run(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def test_op1(spark):
    docs = table("documents", "doc_id, source, text")
    size = {d: max(1, len(words(t))) for d, _, t in docs}
    of = {d: s for d, s, _ in docs}
    tokens = Counter()
    for d, s, _ in docs:
        tokens[s] += size[d]
    logs = [math.log(n / sum(tokens.values())) for n in tokens.values()]
    # The least exponent at which the most repeated source is read twice while the least repeated is read once.
    a = max(0.0, 1 - math.log(2) / (max(logs) - min(logs)))
    raised = {s: (n / sum(tokens.values())) ** a for s, n in tokens.items()}
    cover = max(tokens[s] / raised[s] for s in tokens)
    used = Counter(r["doc_id"] for r in run(spark, "op1_source_mixing"))
    assert set(used) == set(size)
    for s in tokens:
        want, most = raised[s] * cover, max(size[d] for d in size if of[d] == s)
        got = sum(size[d] * k for d, k in used.items() if of[d] == s)
        assert want * 0.999 - 1 <= got <= want * 1.001 + most + 1
        assert all(math.floor(want / tokens[s] * 0.999) <= k <= math.ceil(want / tokens[s] * 1.001) for d, k in used.items() if of[d] == s)


def test_op3(spark):
    got = run(spark, "op3_html_extraction")
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in table("pages", "page_id"))
    assert all(r["n_chars"] == len(r["text"]) for r in got) and all("<" not in r["text"][:1] for r in got)


def test_op4(spark, texts):
    tokens = {d: words(t) + [None] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in run(spark, "op4_lm_scoring"):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0 and (len(ws) < 20 or r["bits_per_byte"] < 6)


def test_op5(spark):
    rows = [(i, np.array(v, float)) for i, v in table("embeddings", "vec_id, embedding") if v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in run(spark, "op5_additive_quantisation"):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == sorted(i for i in ids if i % 100 == 0)
    hit = 0
    for q, found in got.items():
        gap = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        gap[ids == q] = np.inf
        best = ids[np.lexsort((ids, gap))[:10]]
        assert sorted(found) == list(range(1, min(10, len(ids) - 1) + 1))
        assert all(s == pytest.approx(gap[ids == v][0], rel=1e-12) for v, s in found.values())
        hit += len(set(best.tolist()) & {v for v, _ in found.values()})
    assert hit >= 0.9 * 10 * len(got)


def test_op6(spark, texts):
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op6_token_output")]
    assert sorted(got) == brute.tokens(sorted(texts), queries.tokenizer_path())


def test_op7(spark, texts):
    want = brute.contamination(texts, table("benchmark", "item_id, text"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run(spark, "op7_benchmark_decontamination")}
    assert got == want and any(v[4] for v in want.values())


def test_op8(spark, texts):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op8_ngram_jaccard_join")} == brute.components(texts, 4, 85)


def test_op9(spark, texts):
    whole = dict(texts)
    for r in run(spark, "op9_pii"):
        base = brute.pii(whole[r["doc_id"]] or "")
        assert r["base_sha256"] == sha(",".join(base))
        assert all(r[f"n_{k}"] == sum(x.startswith(k + ":") for x in base) for k in ("email", "ip", "card", "phone"))
        assert set(base) <= set(r["spans"].split(","))


def test_op10(spark):
    lang = {d: x for d, x in table("documents", "doc_id, lang")}
    got = run(spark, "op10_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)
