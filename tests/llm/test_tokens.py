import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from codeloom.llm import tokens as K

WHOLE = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
WHOLE.encode_special_tokens = True
PATH = K.default_vocabulary()


def same(s):
    cut = K.chunks(s)
    assert "".join(cut) == s and all(len(c) <= K.LONGEST for c in cut)
    return K.join_chunks(cut, [K.encode_chunk(c, PATH) for c in cut], PATH) == WHOLE.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t'slte1２é漢!?.\r", max_size=2500))
def test_dirt(s):
    assert same(s)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=600))
def test_any_text(s):
    assert same(s)


@pytest.mark.parametrize("s", ["a" * 30_000, " " * 9000 + "x", "x" + "\n" * 5000 + " y", "it's they'll " * 900, "<|endoftext|>" * 99, "😀" * 700, "漢字" * 3000])
def test_long_runs(s):
    assert same(s)


def test_equal_passages_are_cut_alike():
    shared = "".join(f"word{i} and some more of it, " for i in range(200))
    a, b = K.chunks("first " * 50 + shared), K.chunks("another beginning " * 33 + shared)
    assert len(set(a) & set(b)) > 0.8 * len(K.chunks(shared))


def test_table(spark):
    rows = [(1, "Hello world, it's fine."), (2, None), (3, ""), (4, "Hello world, it's fine."), (5, " "), (1, "Hello world, it's fine."), (None, "x"), (6, "<|endoftext|>"), (7, "q " * 40_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, chunk string, place int")
    got = {r["doc_id"]: r["ids"] for r in K.encoded(df).collect()}
    assert len(got) == 8
    for i, t in rows:
        assert got[i] == (WHOLE.encode(t, add_special_tokens=False).ids if t else [])
    assert K.encoded(df.limit(0)).count() == 0


def test_the_filter_has_every_shared_key(spark):
    import numpy as np

    keys = [K.chunk_key(f"chunk {k}") for k in range(3000)]
    bits, filter_ = K._shared_filter(spark.createDataFrame(keys[:1500], "ka long, kb long"))
    hits = K._in_filter(keys, bits, np.frombuffer(filter_, dtype=np.uint8))
    assert all(hits[:1500]) and sum(hits[1500:]) < 150
    bits, filter_ = K._shared_filter(spark.createDataFrame([], "ka long, kb long"))
    assert not any(K._in_filter(keys, bits, np.frombuffer(filter_, dtype=np.uint8)))


def test_texts_cut_together_are_cut_as_alone():
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("abc é漢\n ") for _ in range(r.choice((0, 5, 64, 300, 4000)))) for _ in range(60)]
    assert [[t[a:b] for a, b in zip([0, *e], e)] for t, e in zip(texts, K.cuts_of(texts))] == [K.chunks(t) for t in texts] == list(K.chunked(texts))


def test_shared_and_single_chunks_meet(spark):
    """Documents of own and shared passages in any order, one passage in a third of all."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg'") for _ in range(r.randint(1, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    hot, warm = passage(300), [passage(120) for _ in range(6)]
    rows = [(k, passage(r.randint(1, 90)) + r.choice(["", " ", hot if k % 3 == 0 else r.choice(warm)]) + passage(r.randint(0, 90))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["ids"] for x in K.encoded(df).collect()}
    assert got == {k: WHOLE.encode(t, add_special_tokens=False).ids for k, t in rows}
