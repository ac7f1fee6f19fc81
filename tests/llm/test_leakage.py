import random

import pytest

from codeloom.llm import leakage as L

r = random.Random(4)
NOUNS = [f"noun{i}" for i in range(400)]
SENTENCE = lambda: "When " + " ".join(r.choice(NOUNS) for _ in range(14)) + " then it ends."
ITEM = [SENTENCE() for _ in range(6)]
ZH = ["当凭证的日志在分支中间截断时判断路由和队列谁应当负责第539步的清理工作。", "若账本与分支在第364天同时更名请计算信标第二轮之后还剩多少个货单。", "已知项目批次有670个成员但货单的快照为空请说明为什么路由不会成为分支的子节点。"]
INDEX = L.Index([(7, "en", " ".join(ITEM)), (8, "zh", "".join(ZH)), (9, "en", "too few"), (10, None, None)])


def found(text):
    return {i for _, i, _ in L.leaks(iter([(1, text)]), INDEX)}


def changed(s):
    w = s.split()
    w[len(w) // 2] = "altered"
    return " ".join(w)


@pytest.mark.parametrize(
    "text",
    [
        " ".join(ITEM), " ".join(ITEM[:3]), "x y z. " * 50 + " ".join(ITEM[1:5]) + " tail" * 50, f"{ITEM[0]} other words between. {ITEM[2]} and more of that. {ITEM[4]}",
        " ".join(ITEM[:4]).upper(), "\n".join("// " + s for s in ITEM[:4]), " ".join(f"**{w}**" for w in " ".join(ITEM[:4]).split()), " ".join(map(changed, ITEM[:4])),
        " ".join(ITEM[:4]).replace("o", "o​"), " ".join(ITEM[:4]).translate({c: c + 0xFEE0 for c in range(33, 127)}), "<p>" + "<br>".join(ITEM[:4]) + "</p>",
    ],
)
def test_found(text):
    assert found(text) == {7}


@pytest.mark.parametrize("text", ["", " ", ITEM[0], " ".join(ITEM[:2]), " ".join(reversed(ITEM)), " ".join(ITEM[k].split()[j] for k in range(6) for j in range(0, 16, 2)), "stock words only"])
def test_not_found(text):
    assert found(text) == set()


def test_characters_of_unspaced_scripts():
    assert found("甲" * 30 + "".join(ZH[:2]) + "乙" * 30) == {8}
    assert found(" ".join("".join(ZH))) == {8}
    assert found(ZH[0]) == set()


def brute(d, index=INDEX):
    ts = L.tokens(d)
    out = set()
    for i, chars, item, weight, total in index.items:
        if L.share(item, weight, total, ts, L.grams(ts, min(L.RUN, len(item))), L.PIECE_CHARS if chars else L.PIECE_WORDS) >= L.SHARE:
            out.add(i)
    return out


@pytest.mark.parametrize("every", range(4, 13))
def test_changed_words_at_any_distance(every):
    """Every `every`-th word of a copy is changed: the index finds what the verification accepts, and that is all copies from every fifth on."""
    hits = 0
    for _ in range(60):
        item = [r.choice(NOUNS) for _ in range(60)]
        index = L.Index([(1, "en", " ".join(item))])
        off = r.randrange(every)
        text = " ".join("changed" if k % every == off else w for k, w in enumerate(item))
        want = brute(text, index)
        assert {i for _, i, _ in L.leaks(iter([(1, text)]), index)} == want
        hits += len(want)
    assert hits == (60 if every >= 5 else 0)


@pytest.mark.parametrize("lang", ["en", "zh"])
def test_random_edits(lang):
    """Changed, dropped and added tokens in any mixture, pieces in any order."""
    signs = [chr(0x4E00 + k) for k in range(300)] if lang == "zh" else NOUNS
    glue = "" if lang == "zh" else " "
    for _ in range(150):
        item = [r.choice(signs) for _ in range(r.randint(3, 90))]
        index = L.Index([(1, lang, glue.join(item))])
        out = []
        p = r.choice((0.05, 0.1, 0.2))
        for w in item[r.randint(0, len(item) // 2) :]:
            x = r.random()
            out += [r.choice(signs)] if x < p else [] if x < 1.5 * p else [w, r.choice(signs)] if x < 2 * p else [w]
        text = glue.join([r.choice(signs) for _ in range(20)] + out + [r.choice(signs) for _ in range(20)])
        assert {i for _, i, _ in L.leaks(iter([(1, text)]), index)} == brute(text, index)


def test_an_item_repeated_very_often_takes_no_quadratic_time():
    import time

    t = time.time()
    assert found((" ".join(ITEM) + " ") * 2000) == {7}
    assert time.time() - t < 30


def test_the_index_loses_nothing_to_brute_force():
    docs = [" ".join(r.sample(ITEM, r.randint(0, 4)) + [SENTENCE() for _ in range(r.randint(0, 9))]) for _ in range(150)]
    for d in docs:
        assert found(d) == brute(d)


def test_fingerprints_within_the_radius_share_a_block():
    import numpy as np

    f = np.array([r.getrandbits(64) for _ in range(200)], dtype=np.uint64)
    for x in f.tolist():
        y = x
        for b in r.sample(range(64), L.RADIUS):
            y ^= 1 << b
        assert any((x >> k * L.BITS) & 0xFFFF == (y >> k * L.BITS) & 0xFFFF for k in range(L.BLOCKS))


def test_table(spark):
    docs = [(1, " ".join(ITEM)), (1, " ".join(ITEM)), (2, None), (3, ""), (4, " ".join(ITEM[:4])), (None, " ".join(ITEM)), (5, "word " * 100_000 + " ".join(ITEM))]
    d = spark.createDataFrame([(*x, 3, "en") for x in docs], "doc_id long, text string, item_id long, lang string")
    items = [(7, "en", " ".join(ITEM)), (7, "en", " ".join(ITEM)), (8, None, None), (9, "en", " ".join(ITEM))]
    i = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, lang string, text string, share double")
    got = {(x["doc_id"], x["item_id"]) for x in L.leaked(d, i).collect()}
    assert got == {(k, q) for k in (1, 4, None, 5) for q in (7, 9)}
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0


def test_large_ids_beside_a_null_one(spark):
    big = (1 << 62) + 1
    d = spark.createDataFrame([(big, " ".join(ITEM)), (None, " ".join(ITEM))], "doc_id long, text string").coalesce(1)
    i = spark.createDataFrame([(7, "en", " ".join(ITEM))], "item_id long, lang string, text string")
    assert {x["doc_id"] for x in L.leaked(d, i).collect()} == {big, None}
