from hypothesis import given
from hypothesis import strategies as st

from millrace.llm.sentences import sentence_units, split_sentences


def units(text, language="eng_Latn"):
    return [text[a:b] for a, b in sentence_units(text, language)]


def test_abbreviations_and_numbers():
    assert units("Mr. Fay paid 3.50 at St. Ann. It rained.") == ["Mr. Fay paid 3.50 at St. Ann.", "It rained."]
    assert units("We met at 5 p.m. The mill ran. See Fig. 3 e.g. there.") == ["We met at 5 p.m.", "The mill ran.", "See Fig. 3 e.g. there."]
    assert units("B. C. Fay came. The N.O.R. council sat.") == ["B. C. Fay came.", "The N.O.R. council sat."]
    assert units("रु. पाँच। दूसरा।", "hin_Deva") == ["रु. पाँच।", "दूसरा।"]


def test_quotations():
    assert units("“Is it so?” asked Quel, and left. Then he came.") == ["“Is it so?” asked Quel, and left.", "Then he came."]
    assert units("He said “it is so.” Then he left.") == ["He said “it is so.”", "Then he left."]
    assert units('"One. Two," she said. Three.') == ['"One. Two," she said.', "Three."]


def test_brackets():
    assert units("The mill (is it old?) stands. (It is old.) Good.") == ["The mill (is it old?) stands.", "(It is old.)", "Good."]


def test_ellipses():
    assert units("Wait… the mill runs... And stops.") == ["Wait… the mill runs...", "And stops."]
    assert units("यह… वह।", "hin_Deva") == ["यह… वह।"]


def test_lines_lists_and_headings():
    assert units("A heading\n\nOne line\nruns on. Two.\n- item one\n- item two\n1. third item") == ["A heading", "One line\nruns on.", "Two.", "- item one", "- item two", "1. third item"]


def test_unspaced_scripts():
    assert units("一句。二句！「三句。」と言う。", "jpn_Jpan") == ["一句。", "二句！", "「三句。」と言う。"]
    assert units("ก ข 12 ค Mill ง จ", "tha_Thai") == ["ก", "ข 12 ค Mill ง", "จ"]
    assert units("ایک ہے۔ دو ہے؟", "urd_Arab") == ["ایک ہے۔", "دو ہے؟"]


def test_marks_without_partners_cost_no_more():
    import time

    began = time.time()
    for text in ("(" * 60_000 + "”" * 60_000, "“a” " * 40_000, '"' * 60_001, "ก (ข) " * 30_000, "(ก" * 30_000 + " ข" * 30_000):
        for language in ("eng_Latn", "tha_Thai"):
            sentence_units(text, language)
    assert time.time() - began < 60


def test_empty_and_long():
    assert sentence_units(None, None) == sentence_units("", "x") == sentence_units(" \n\n ", "eng_Latn") == []
    text = "A mill ran here. " * 20_000
    assert len(sentence_units(text, None)) == 20_000


GAP = " \n​"  # what may lie between units: white space and invisible characters


@given(st.text(alphabet="aB .!?\n\"“”()…。「」1​-'", max_size=60), st.sampled_from(["eng_Latn", "hin_Deva", "tha_Thai", "jpn_Jpan", None]))
def test_units_cover_all_text_in_order(text, language):
    at = 0
    for a, b in sentence_units(text, language):
        assert a < b and text[a:b] == text[a:b].strip() and not text[at:a].strip(GAP)
        at = b
    assert not text[at:].strip(GAP)


def test_operator(spark):
    df = spark.createDataFrame([("d", "One. Two.", None, 1), ("d", "One. Two.", None, 1), ("e", None, "eng_Latn", 2), ("f", " ", "eng_Latn", 3)], "id string, text string, language string, sentence_no int")
    rows = split_sentences(df).collect()
    assert [(r["id"], r["sentence_no"], r["char_start"], r["char_end"], r["text"]) for r in rows] == [("d", 0, 0, 4, "One."), ("d", 1, 5, 9, "Two.")] * 2
    assert split_sentences(df.limit(0)).count() == 0


def test_by_script_and_locale_data(spark):
    from millrace.llm.sentences import split_sentences

    thai = "วันนี้อากาศดี เราไปตลาดกัน"
    rows = [
        ("a", "Das ist z.B. ein Haus. Der Hrn. Kunz kam.", "deu_Latn"), ("b", "La Sra. Ruiz vino. Fue bien.", "spa_Latn"), ("c", "Он жил на ул. Ленина. Потом уехал.", "rus_Cyrl"),
        ("d", thai, "tha_Thai"), ("e", thai, None), ("f", "ສະບາຍດີທຸກຄົນ ຂ້ອຍຢູ່ບ້ານ", "lao_Laoo"), ("g", "ಡಾ. ರಾವ್ ಬಂದರು. ಅವರು ಹೋದರು.", "kan_Knda"), ("h", "He left.Then it rained.", "eng_Latn"), ("i", "She has a Ph.D. in law. Yes.", None),
    ]
    df = spark.createDataFrame(rows, "id string, text string, language string")
    got = {}
    for r in split_sentences(df).orderBy("id", "sentence_no").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got["a"] == ["Das ist z.B. ein Haus.", "Der Hrn. Kunz kam."] and got["b"] == ["La Sra. Ruiz vino.", "Fue bien."] and got["c"] == ["Он жил на ул. Ленина.", "Потом уехал."]
    assert got["d"] == got["e"] == thai.split(" ") and len(got["f"]) == 2 and got["g"] == ["ಡಾ. ರಾವ್ ಬಂದರು.", "ಅವರು ಹೋದರು."]
    assert got["h"] == ["He left.", "Then it rained."] and got["i"] == ["She has a Ph.D. in law.", "Yes."]
