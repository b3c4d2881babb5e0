import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import sentences as S
from docquarry.llm.sentences import sentences, split

CASES = [
    "The lever (A. B. Smith type) is fitted.|U.S. Pat. No. 7,600,557 describes a valve.|It has a length of .04 in. and a width of 3° C.|No part is needed.",
    'The operator sees the notice "Keep closed."|The user then waits.|A label reads "Ready? Press start." next to it.|Will it hold?!|(It does.)',
    "Prof. Miller and Smith Co. Ltd. tested it on 28 Sept. 2009.|Parts are a film, a relay, etc.|It is cleaned ... or at least wiped ... daily.|[0054] The end is shown.",
    "It is kept at 8 N vs. about 9 N here.|Tests ran from 6 a.m. to 9 p.m. with a coil.|See www.example.org/a.html for e.g. the pump.|pH values of 4.2 to 6.9 protect it.",
    "A load of about 4 N.|The ratio is 1.4:1 (cf. Sec. 3.2).|7 mm of clearance is left.|It stops after 5 min.|The unit has min. dia. 7 cm.",
    "Die 3. Ausführung zeigt Filter ohne Kühler.|Am 17. Mai wurde Platte geprüft.|Die Firma liefert Pumpe unter Nr. 8.|Der Abstand beträgt ca. 1.350,5 mm bzw. 7 bar.|Das Schild „Achtung! Druck.“ ist angebracht.|Die Baugruppe umfasst z. B. Regler, d. h. Teile.",
    "L'étiquette porte « Danger ! Pression. » près du boîtier.|M. Dupont propose un joint, c.-à-d. un clapet.|Est-il encore fermé ?|La distance est d'env. 7 bar (réf. 6.4).",
    "El Sr. Pérez propone bomba con el núm. 3.|¿Está cerrada?|¡No abrir nunca!|El rótulo «No abrir. Caliente.» figura en eje, p. ej. sin juego.",
    "Узел содержит корпус и т. д. внутри вала.|Надпись «Внимание! Давление.» нанесена на клапан.|Через 9 мин. элемент возвращается.|На рис. 5 показан вал.",
    "작동 중 밸브는 3.8 mm로 민다.|표지에는 “주의! 압력.”라고 적혀 있다.|닫혀 있는가?",
    "डॉ. Fenwick के अनुसार पंप पर्याप्त है।|पट्ट पर “सावधान! दबाव।” लिखा है।|5 मि. बाद आवरण लौटता है।|क्या वाल्व बंद है?",
    "قال د. Fenwick إن الغلاف كاف.|كتب على اللوحة «انتبه! ضغط.» قرب الصمام.|هل الغلاف مغلق؟|يبلغ طول العمود نحو 3.4 مم.|لذلك يبقى بعيدا.",
]
UNSPACED = [
    "作業者は「弁を交換する。」|図8.8に示すように、弁を囲む。|表示部には「注意！圧力。」と記載される。|閉じているか？",
    "操作员说：“请更换支撑板。”|实施例84采用壳体。|标牌上写有“注意！压力。”并靠近壳体。|因此弹簧离开薄膜……并返回线圈。",
]


def units(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    expected = case.split("|")
    assert units(" ".join(expected)) == expected


@pytest.mark.parametrize("case", UNSPACED)
def test_boundaries_without_blanks(case):
    assert units(case.replace("|", "")) == case.split("|")


def test_thai():
    assert units("ความยาวประมาณ 3.9 มม. ในแนวราบ ห้ามเปิดท่อ ตามรูปที่ 9.3 คันโยก") == ["ความยาวประมาณ 3.9 มม. ในแนวราบ", "ห้ามเปิดท่อ", "ตามรูปที่ 9.3 คันโยก"]


def test_lines():
    assert units("BACKGROUND\nThe pump is shown. It\nruns well.\nExample 3\nAnother pump is shown here.") == [
        "BACKGROUND", "The pump is shown.", "It\nruns well.", "Example 3", "Another pump is shown here.",
    ]
    assert units("The pump is closed.The valve is open.\n\nA last one without an end\n\nX") == ["The pump is closed.", "The valve is open.", "A last one without an end", "X"]
    assert units("It is 5 cm.U.S. Pat. No. 7 is old.It is 9° C.The end is 4 N.Ser. No. 5 holds.") == ["It is 5 cm.", "U.S. Pat. No. 7 is old.", "It is 9° C.", "The end is 4 N.", "Ser. No. 5 holds."]
    assert units("No end at all") == ["No end at all"] and units(" \n\t ") == [] and units("") == []


@pytest.mark.parametrize("marks", ['""', "“”", "„“", "()", "«»", "[]", "「」"])
def test_quotations_of_any_number_of_sentences_stay_whole(marks):
    for n in (1, 2, 3, 4, 8, 20, 50):
        first = f"The manual reads {marks[0]}{' '.join(['Close the valve now.'] * n)}{marks[1]} and then stops."
        assert units(f"{first} The valve closes.") == [first, "The valve closes."]


def test_stray_marks_join_nothing():
    assert units('A 5" pipe holds. A 6" one (too. It is "so. Go on. The end is near.') == ['A 5" pipe holds.', 'A 6" one (too.', 'It is "so.', "Go on.", "The end is near."]


def test_long_sentence_stays_whole():
    long = "The body " + "of 5 mm. of steel etc. and of 6 cm. or " * 200 + "ends."
    assert units(f"A first one. {long} A last one.") == ["A first one.", long, "A last one."]


def brute_spans(starts, ends, scores, depths):
    """The best sum over every division, each span tried."""
    n, best = len(ends), [0.0]
    for j in range(n):
        tops = [best[i] + S._LENGTHS[min(ends[j] - starts[i], S.FAR)] + (S.UNBALANCED * depths[i - 1] if i else 0) for i in range(j + 1)]
        best.append(max(tops) + scores[j] + (S.UNBALANCED * depths[j] if j + 1 < n else 0))
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.sampled_from([-8.0, -4.0, -3.0, -2.0, 0.5, 1.5, 4.0, 40.0]), st.integers(0, 2)), min_size=1, max_size=14))
def test_program_equals_every_division(pieces):
    starts, ends, at = [], [], 0
    for n, _, _ in pieces:
        starts.append(at)
        ends.append(at + n)
        at += n + 1
    scores, depths = [s for _, s, _ in pieces], [d for _, _, d in pieces]
    got = S._best_spans(starts, ends, scores, depths)
    assert [a for a, _ in got] == [0, *(b + 1 for _, b in got[:-1])] and got[-1][1] == ends[-1]
    total = 0.0
    for a, b in got:
        i, j = starts.index(a), ends.index(b)
        total += S._LENGTHS[min(b - a, S.FAR)] + scores[j] + (S.UNBALANCED * depths[i - 1] if i else 0) + (S.UNBALANCED * depths[j] if j + 1 < len(ends) else 0)
    assert abs(total - brute_spans(starts, ends, scores, depths)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text("aB. !?\n\"“”()1。いท ", max_size=60))
def test_all_text_is_covered(text):
    got = sentences(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in got)) == re.sub(r"\s", "", text)


def test_long_text_is_linear():
    text = "The pump is e.g. closed (see Fig. 3). " * 20_000
    assert len(sentences(text)) == 20_000


def test_abbreviations_are_learned(spark):
    """Words that no list holds: what goes on with numbers or small letters after a period is learned, what ends sentences is not."""
    rows = [(k, f"See blk. {k} of the plan. The qty. of parts is fixed. It rests on the frame. Next {k}.") for k in range(60)]
    df = spark.createDataFrame(rows, "row long, abstract string").withColumn("word", F.lit(1))
    learned = S.learn(df, {"abstract": "Abstract"})
    assert learned == {"blk": "numbered", "qty": "maybe"}
    text = "It is in blk. 7 there. The qty. 4 is left. So it rests on the frame. 9 are left."
    assert [text[a:b] for a, b in sentences(text)] != [text[a:b] for a, b in sentences(text, learned)]
    assert [text[a:b] for a, b in sentences(text, learned)][0] == "It is in blk. 7 there."
    assert S.learn(df.limit(0), {"abstract": "Abstract"}) == {}


def test_table(spark):
    rows = [(1, "One. Two.", None), (1, "One. Two.", None), (None, "", "Three!"), (2, "  ", "Abc\U0001d11e. So it is.")]
    df = spark.createDataFrame(rows, "row long, abstract string, description string").withColumns({"key": F.lit(1), "ct": F.lit("x"), "z0": F.lit(1)})
    got = sorted(map(str, (tuple(r) for r in split(df, "row", {"abstract": "Abstract", "description": "Description"}).collect())))
    assert got == sorted(map(str, [(1, "Abstract", 0, 4), (1, "Abstract", 5, 9)] * 2 + [(None, "Description", 0, 6), (2, "Description", 0, 5), (2, "Description", 6, 15)]))
    assert split(df.limit(0), "row", {"abstract": "A"}).count() == 0
