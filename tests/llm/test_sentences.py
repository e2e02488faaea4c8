import time

import pytest
from conftest import DATA

from skyframe.llm import sentences as s

CASES = [
    ("prose", "One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("prose", "Dr. A. B. Smith et al. saw approx. 3.5 stars (cf. Fig. 2) at 3 a.m. The end.", ["Dr. A. B. Smith et al. saw approx. 3.5 stars (cf. Fig. 2) at 3 a.m.", "The end."]),
    ("prose", "We saw stars, etc. The dome closed at 3 a.m. local time.", ["We saw stars, etc.", "The dome closed at 3 a.m. local time."]),
    ("prose", "“It failed!” shouted the keeper. He wrote: “It works.” Then he left.", ["“It failed!” shouted the keeper.", "He wrote: “It works.”", "Then he left."]),
    ("prose", 'The log says "no quads found." and ends. Next.', ['The log says "no quads found." and ends.', "Next."]),
    ("prose", "It slipped (was it dim?) near dawn. (The pole moved slowly.) It stopped... then went on.", ["It slipped (was it dim?) near dawn.", "(The pole moved slowly.)", "It stopped... then went on."]),
    ("prose", "See a_1.fit and 1.2.3. It fell to .43 mag in x_2.ini. tool ran.", ["See a_1.fit and 1.2.3.", "It fell to .43 mag in x_2.ini.", "tool ran."]),
    ("prose", "It ended too early.The next began.", ["It ended too early.", "The next began."]),
    ("prose", "Am 23. März war z. B. die Nr. 5 da, d. h. hier. „War es gut?“, fragte er.", ["Am 23. März war z. B. die Nr. 5 da, d. h. hier.", "„War es gut?“, fragte er."]),
    ("prose", "M. Dupont a vu env. 3 poses, p. ex. ici. « Est-ce bon ? » demanda-t-il.", ["M. Dupont a vu env. 3 poses, p. ex. ici.", "« Est-ce bon ? » demanda-t-il."]),
    ("prose", "¿Por qué? La Dra. Ruiz llegó a las 4.29 h. «¿Está claro?», preguntó.", ["¿Por qué?", "La Dra. Ruiz llegó a las 4.29 h.", "«¿Está claro?», preguntó."]),
    ("prose", "В 2025 г. фон и др. данные сравнили. «Где?» — спросил он. Кадр исчез… затем вернулся.", ["В 2025 г. фон и др. данные сравнили.", "«Где?» — спросил он.", "Кадр исчез… затем вернулся."]),
    ("prose", "А. В. Петров и С. Иванов ушли.", ["А. В. Петров и С. Иванов ушли."]),
    ("prose", "本当か？！値は7．4だ．「消えた。」と書いた。霧……それでも見た。", ["本当か？！", "値は7．4だ．", "「消えた。」と書いた。", "霧……それでも見た。"]),
    ("prose", "他写道：“已经好了。”第二天（晴的那个。）来了！他问：“好吗？”然后走了。", ["他写道：“已经好了。”", "第二天（晴的那个。）来了！", "他问：“好吗？”然后走了。"]),
    ("prose", "क्या साफ़ है? डॉ. राम ने देखा। “कहाँ है?” उसने पूछा।", ["क्या साफ़ है?", "डॉ. राम ने देखा।", "“कहाँ है?” उसने पूछा।"]),
    ("prose", "هل كانت واضحة؟ سأل المراقب: «أين السماء؟» ثم أغلق القبة.", ["هل كانت واضحة؟", "سأل المراقب: «أين السماء؟» ثم أغلق القبة."]),
    ("prose", "เราตรวจดาว สถานี Rufura บันทึกภาพ 12 ดวง", ["เราตรวจดาว", "สถานี Rufura บันทึกภาพ 12 ดวง"]),
    ("prose", "# A heading\n\n- one item\n2. second item\nText.", ["# A heading", "- one item", "2. second item", "Text."]),
    ("wrapped", "A line that\ngoes on. Next\none.\n\nNew part", ["A line that\ngoes on.", "Next\none.", "New part"]),
    ("lines", "A. B.\r\n\n  C? D \n", ["A. B.", "C? D"]),
    ("prose", "(see « « note. More text) and it went on. Next.", ["(see « « note. More text) and it went on.", "Next."]),
    ("prose", "(see « « « « « « note. More text) and it went on. Next.", ["(see « « « « « « note. More text) and it went on.", "Next."]),
    ("prose", "1. Setup\n1.1. Mount the camera. Check it.\n1.2. Heading\n2. Run it.", ["1. Setup", "1.1. Mount the camera.", "Check it.", "1.2. Heading", "2. Run it."]),
    ("prose", "i. First item\nii. Second item\niii. Third. More.\niv. Item", ["i. First item", "ii. Second item", "iii. Third.", "More.", "iv. Item"]),
    ("prose", "a. One\ni. Under one\nii. More\nb. Two", ["a. One", "i. Under one", "ii. More", "b. Two"]),
    ("prose", "3.14. That was the value.\nmix. It was stirred.", ["3.14.", "That was the value.", "mix.", "It was stirred."]),
    ("prose", "On 5. Oct. we saw it. Ver. 2.0.1 is out. Am 3. Okt. war es klar.", ["On 5. Oct. we saw it.", "Ver. 2.0.1 is out.", "Am 3. Okt. war es klar."]),
    ("prose", "File " + "x" * 60 + "_1.Fit was read. Next.", ["File " + "x" * 60 + "_1.Fit was read.", "Next."]),
    ("prose", 'An "unclosed quote. And on. (Or this. End', ['An "unclosed quote.', "And on.", "(Or this.", "End"]),
]


@pytest.mark.parametrize("layout,text,units", CASES)
def test_cases(layout, text, units):
    assert [text[a:b] for a, b in s.sentences(text, layout)] == units


@pytest.mark.parametrize("text", [None, "", " \n\t  "])
def test_nothing(text):
    assert s.sentences(text, "prose") == []


def test_long_text_is_covered_once():
    text = 'The "old (very. odd) log" said: it failed. ' * 20_000
    units = s.sentences(text, None)
    assert len(units) >= 20_000
    rest, at = [], 0
    for a, b in units:
        assert a >= at and a < b and not text[a].isspace() and not text[b - 1].isspace()
        rest.append(text[at:a])
        at = b
    assert not "".join(rest).strip() and not text[at:].strip()


@pytest.mark.parametrize("text", ["_1.Ab" * 60_000, "(« " * 60_000 + ". " + ") " * 60_000, "am 5. " * 60_000, "a. " * 60_000, "x." * 60_000])
def test_time_is_linear_in_the_length(text):
    begin = time.process_time()
    s.sentences(text, "prose")
    assert time.process_time() - begin < 10


def test_every_document_is_covered(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {}
    for r in s.sentence_units(docs.union(docs)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    for r in docs.where("text is not null").collect():
        units = sorted(got.pop(r["doc_id"], []))
        assert units == sorted(set(units)) and all(x[1] <= y[0] for x, y in zip(units, units[1:]))
        assert "".join(r["text"][a:b] for a, b in units).split() == r["text"].split() or "".join("".join(r["text"][a:b] for a, b in units).split()) == "".join(r["text"].split())
    assert not got


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, layout string, start_char string"
    assert s.sentence_units(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "A b. C d.", None, "x"), (None, "A b.", "prose", "x"), (2, None, "prose", "x")]
    assert s.sentence_units(spark.createDataFrame(rows, schema)).count() == 2
