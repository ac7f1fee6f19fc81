import pytest

from codeloom.llm import sentences as S

MODEL = S.fit(S.seed_texts())


def cut(text, model=MODEL):
    return [text[a:b] for a, b in S.units(text, model)]


@pytest.mark.parametrize(
    "units",
    [
        ["Mr. Hall met Dr. Ives at 9 a.m. on Jan. 4, 2020.", "They left."], ["“Is it done?” she asked.", "It was."], ["He said “not yet.”", "Then it ended!"], ["It took 3.5 s, i.e. twice as long.", "Why?", "No idea…", "Next."],
        ["Das gilt z. B. für den 2. Lauf am 25. Mai.", "„Ist das so?“, fragte er.", "Ende."], ["« C'est vrai ! » dit-elle.", "Pourquoi ?", "M. Roux part."], ["«¿Ya?», dijo.", "¡Vamos!", "El Sr. Paz vio la pág. 5."],
        ["«Готово?» — спросил он.", "Да!", "Проф. Ильин ушёл."], ["यह घर है।", "“क्या?” उसने पूछा।"], ["هذا بيت.", "لماذا؟"],
    ],
)
def test_spaced(units):
    assert cut(" ".join(units)) == units


@pytest.mark.parametrize("units", [["今天下雨。", "“走吗？”他问。", "他说：“好。”", "我们走了……", "结束！"], ["「はい。」と言った。", "雨です。", "本当ですか？"]])
def test_unspaced(units):
    assert cut("".join(units)) == units


def test_unmarked_scripts_are_cut_by_their_letters():
    assert cut("เขาซื้อ ข้าว ปลา และ ผัก ที่ตลาด") == ["เขาซื้อ ข้าว ปลา และ ผัก ที่ตลาด"]
    assert cut("วันนี้ฝนตกเราไม่ไปตลาดพรุ่งนี้ค่อยไป") == ["วันนี้ฝนตก", "เราไม่ไปตลาด", "พรุ่งนี้ค่อยไป"]


def test_initials_before_a_sentence():
    assert cut("See sec. 4 for it. Then go to Washington D.C. It rains.") == ["See sec. 4 for it.", "Then go to Washington D.C.", "It rains."]


def test_held_out_thai():
    """A model of half the Thai sentences of a corpus, against sentences of the other half: joined by spaces, and with spaces inside."""
    import random
    from pathlib import Path

    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    known = sorted(set(S.unmarked_sentences([t for t in pq.read_table(path)["text"].to_pylist() if t])))
    r = random.Random(2)
    r.shuffle(known)
    half = len(known) // 2
    model = S.fit(S.seed_texts() + [" ".join(known[:half])])
    right = all_ = 0
    for _ in range(200):
        few = [r.choice(known[half:]) for _ in range(3)]
        got = cut(" ".join(few), model)
        right += sum(u in got for u in few)
        all_ += 3
    assert right / all_ > 0.8


def test_thai():
    assert cut("วันนี้ฝนตก เราไม่ไปตลาด") == ["วันนี้ฝนตก", "เราไม่ไปตลาด"]


def test_blocks():
    s = "﻿# Head. line\ntext one.\nsame para\n\n- item a. B c.\n* item two\n1) third\n> quoted. More.\n```\ncode. Here.\n\nmore\n```\nlast"
    assert cut(s) == ["# Head. line", "text one.\nsame para", "- item a.", "B c.", "* item two", "1) third", "> quoted.", "More.", "```\ncode. Here.\n\nmore\n```", "last"]
    assert cut("") == cut(" \n\t\n") == cut("﻿") == []
    assert cut("```\nopen. End.") == ["```\nopen. End."]
    assert cut("a. B\r\n\r\nc") == ["a.", "B", "c"]


def test_viterbi_equals_all_tag_sequences():
    import itertools

    s = "A. Berg e.g. said no. Yes! “So?” he asked… Then it went. OK"
    ps = S.places(s, 0, len(s))
    assert 3 < len(ps) < 12

    def score(tags):
        total, last, start = 0.0, False, 0
        for p, t in zip(ps, tags):
            total += MODEL.w.get(f"T{last:d}{t:d}", 0.0)
            if t:
                total += MODEL.score(p, S._at_start(p, start, s))
                start = p.next
            last = t
        return total

    best = max(itertools.product((False, True), repeat=len(ps)), key=score)
    assert abs(score(best) - score(MODEL.decode(ps, 0, s))) < 1e-9


def test_held_out_agreement(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    texts = sorted({r["text"] for r in spark.read.parquet(str(path)).where("text is not null").collect()})
    model = S.fit(S.seed_texts() + texts[::2])
    same = all_ = 0
    for t in texts[1::2]:
        for a, b, fenced in S.blocks(t):
            ps = [] if fenced else [p for p in S.places(t, a, b) if p.mark != " "]
            got, want = model.decode(ps, a, t), S._label(t, a, ps)
            same += sum(x == y for x, y in zip(got, want))
            all_ += len(ps)
    assert same / all_ > 0.995


def test_table(spark):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, "  \n "), (None, "X."), (5, "word " * 60_000 + "end. Next one."), (6, "😀 Hi. There.")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start_char long, i string")
    got = sorted((r["doc_id"] or 0, r["start_char"], r["end_char"]) for r in S.sentences(df, model=MODEL).collect())
    assert got == [(0, 0, 2), (1, 0, 4), (1, 5, 9), (5, 0, 300_004), (5, 300_005, 300_014), (6, 0, 5), (6, 6, 12)]
    assert S.sentences(df.limit(0)).count() == 0


def test_large_ids_beside_a_null_one(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "One. Two."), (None, "X.")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in S.sentences(df, model=MODEL).collect()} == {big, None}


def test_training_sees_every_document_however_long_and_however_laid_out(spark, monkeypatch):
    """What only a long document teaches is learnt, in one part and in several, and the rows' places change no weight."""
    odd = "Das ist evtl. Lärm im Haus. Es gilt inkl. Strom und Gas. Wir sehen vgl. Tafel im Flur. "
    rows = [(k, f"Note {k} is short. It ends here.") for k in range(40)] + [(99, odd * 300)]
    assert len(rows[-1][1]) > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [u for u in odd.strip().replace("Haus. ", "Haus.|").replace("Gas. ", "Gas.|").split("|")]
    assert cut(odd, S.train(df.repartition(1))) == want
    monkeypatch.setattr(S, "PART", 10_000)
    one, many = S.train(df.repartition(1)), S.train(df.repartition(5))
    assert one.w == many.w and one.edges == many.edges
    assert cut(odd, one) == want
