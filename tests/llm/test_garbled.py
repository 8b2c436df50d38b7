import pytest

from codestrata.llm import garbled as G

GERMAN, RUSSIAN, POLISH = "Größere Änderungen für die Prüfung — „heißt“ hier Öl", "Если сверка пуста, проверка сообщает об ошибке", "Żadna zmiana nie może ominąć usługa, część"


@pytest.mark.parametrize("text", [GERMAN, RUSSIAN, POLISH, "l’été à la clôture", "項目には金額ではなく数量が入っている。"])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"])
def test_utf8_read_as_something_else(text, codec):
    raw = text.encode("utf-8")
    bad = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)
    fixed, n, lost = G.repair(f"see `x`: {bad} end")
    assert n and not lost
    if codec != "mac_roman" or text != RUSSIAN:
        assert fixed == f"see `x`: {text} end"


def test_read_wrongly_twice():
    bad = GERMAN.encode().decode("latin-1").encode().decode("latin-1")
    assert G.repair(bad)[0] == GERMAN


@pytest.mark.parametrize("text", ["┌──┐ │ok│ └──┘ ▒▓█ ░", "src/\n├── a/B.java\n└── c.sql", "IRMÃ da tabela, SECÇÃO, NÃO", "Ёлка, объём, съезд — «в кавычках»", "«СССР»", "Γ δοκιμή, Việt Nam: ước lượng, łódź", "©®™ ∂ ∆ Ω π ÷ ‰ † ‡ ¬ ¶", "👩‍🔧🚢 ✅", "zero​width ﻿", "a\x07b\x1b[0m", "l’échec jusqu’à l’été", "٣٤٥ १२३ Ⅷ ½ ²", None, "", "plain"])
def test_intended_writing_stays(text):
    assert G.repair(text) == (text, 0, False)


def test_lost_characters():
    assert G.repair("fun��o")[2]


def rows(spark):
    good = [(i, f"{GERMAN}. {RUSSIAN}") for i in range(20)]
    swapped = [(100, GERMAN.encode("cp1252", "replace").decode("mac_roman")), (101, RUSSIAN.encode("cp1251").decode("koi8_r")), (102, "nichts für ungut".encode("cp1252").decode("cp850"))]
    other = [(200, None), (201, ""), (202, "ascii"), (203, "verÃ¶ffentlicht"), (203, "verÃ¶ffentlicht"), (204, "s� a"), (205, "項目には金額".encode("euc_jp").decode("latin-1"))]
    return spark.createDataFrame([(a, b, "x") for a, b in good + swapped + other], "doc_id long, text string, word string")


def test_table(spark):
    df = rows(spark)
    assert sorted(r.doc_id for r in G.garbled(df, "doc_id", "text").collect()) == [100, 101, 102, 203, 204, 205]
    fixed = {r.doc_id: (r.fixed, r.lost) for r in G.restore(df, "doc_id", "text").collect()}
    assert fixed[203] == ("veröffentlicht", False) and fixed[204][1] and fixed[101][0] == RUSSIAN and "für" in fixed[102][0] and fixed[205][0] == "項目には金額"
    assert G.garbled(df.limit(0), "doc_id", "text").count() == 0


def test_long_text():
    t = ("für die Größe " * 20_000).encode().decode("cp1252")
    assert G.repair(t)[0] == "für die Größe " * 20_000


def test_copies_of_a_garbled_text_count_once_and_its_rare_words_follow(spark):
    swap = lambda t: t.encode("cp1251").decode("koi8_r")
    right = [(i, f"Проверка номер {i}: если сверка пуста, отчёт уходит в архив") for i in range(8)]
    once = [(20, "Водомерный журнал закрыт")]
    bad = "Если проверка пуста, водомерный журнал и бухгалтерская сверка уходит в архив"
    partly = "Проверка и сверка пуста; тождественность " + swap("если отчёт уходит")
    df = spark.createDataFrame(right + once + [(100 + i, swap(bad)) for i in range(40)] + [(200, partly)], "doc_id long, text string")
    fixed = {r.doc_id: r.fixed for r in G.restore(df, "doc_id", "text").collect()}
    assert fixed == {100 + i: bad for i in range(40)} | {200: "Проверка и сверка пуста; тождественность если отчёт уходит"}


def test_lone_letters_and_signs_of_numbers(spark):
    """A letter that stands alone is told by its rareness; others of the same kind stay."""
    rows = [(i, f"elle a été déplacée à l’été, só é fechada, ruling §{i}") for i in range(120)]
    rows += [(200, "elle a été déplacée Ó l’été"), (201, "só Θ fechada"), (202, "ruling º10"), (203, "ſ ẞ İ ı ² ½ ‡ π"), (204, "額ではなく数量が入っている。 ¹àÌÜ `x`")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fixed for r in G.restore(df, "doc_id", "text").collect()}
    assert got == {200: "elle a été déplacée à l’été", 201: "só é fechada", 202: "ruling §10", 204: "額ではなく数量が入っている。 項目 `x`"}
