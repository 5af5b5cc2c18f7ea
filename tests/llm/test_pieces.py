"""Encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from geofeat.llm import pieces, queries

PATH = queries.piece_model_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.PrefixTable(PATH))


def same(coder, library, text):
    ids = np.frombuffer(coder.encode(text), np.uint16)
    assert ids.tolist() == library.encode(text), text[:80]
    assert coder.decode(ids) == library.decode(ids.tolist()), text[:80]


def test_random_texts(coder, library):
    rng = random.Random(5)
    names = [library.id_to_piece(k) for k in range(259, library.get_piece_size())]
    for _ in range(3000):
        text = "".join(rng.choice(names) for _ in range(rng.randint(0, 9)))
        same(coder, library, text if rng.random() < 0.5 else text.replace("▁", " "))
        same(coder, library, "".join(rng.choice("aeioutnsrh.,;  \n▁\tﬁ漢éÅ①🙂\x00\r​") for _ in range(rng.randint(0, 60))))


@pytest.mark.parametrize("text", ["", " ", "   ", "\n", "\n\n a\n", "a ", " a", " " * 17, " " * 45 + "x", "x" * 3000, "ab " * 3000, "</s><s><unk><0x0A>", "▁▁ ▁a▁", "é́"])
def test_edges(coder, library, text):
    same(coder, library, text)


def test_any_ids_decode_as_the_library_does(coder, library):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 6))]
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_small_caches_change_nothing(library):
    small = pieces.Coder(pieces.PrefixTable(PATH))
    small.table.SIZE = 5
    rng = random.Random(7)
    for _ in range(200):
        same(small, library, " ".join("".join(rng.choice("abcde.,") for _ in range(rng.randint(0, 5))) for _ in range(20)))


def test_neighbours_that_fit_are_those_that_stay(coder, library):
    rng = random.Random(8)
    table = coder.table
    for _ in range(3000):
        a, b = rng.randrange(261, 32000), rng.randrange(261, 32000)
        text = table.names[a] + table.names[b]
        if "▁" not in table.names[b]:
            ids = np.frombuffer(table.part(text), np.uint16).tolist()
            assert table.fits(a, b) == (ids == [a, b])


def test_operator(spark, library):
    texts = ["", None, "a b", "a b", " x\n", "z" * 40_000, "é漢🙂 it's"]
    rows = [(None if k == 3 else k, t, [1], "clash", "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string, __extra string")
    got = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode(docs, PATH, decoded=True).collect()}
    assert got == {(d, tuple([*library.encode(t or ""), 2]), library.decode(library.encode(t or ""))) for d, t, *_ in rows}
    back = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((d, t or "") for d, t, *_ in rows), key=repr)
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library, tmp_path):
    rows = [(1, "Das ist.\n  Ja"), (2, None), (3, "x" * 99)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d, t in rows:
        ids = [*library.encode(t or ""), 2]
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()} == want


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, t: t.lower())
    with pytest.raises(ValueError):
        pieces.PrefixTable(PATH)
