import pytest
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.functions import geometry as G
from lakefold.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(s):
    return F.lit(s)


@pytest.mark.parametrize("text, want", [("ЁЖИК «Большой»", "ежик большой"), ("  Вино\tКрасное  ", "вино красное"), ("Straße ﬁn", "strasse fin")])
def test_canonical(spark, text, want):
    assert one(spark, T.canonical(lit(text))) == want


@pytest.mark.parametrize("text, want", [("Алиготе Баррель 2024", "2024"), ("1950 1999 2000", "1950"), ("1800 3000", None), ("Без года", None)])
def test_year(spark, text, want):
    assert one(spark, T.year(T.canonical(lit(text)))) == want


@pytest.mark.parametrize("text, want", [("Вино столовое сухое 0.75", []), ("Рислинг 2021", ["рислинг"]), ("Рислинг 1000 мл", ["рислинг"]), ("Магнум 1500", ["магнум"]), ("Каберне 750", ["каберне"])])
def test_name_tokens(spark, text, want):
    assert one(spark, T.name_tokens(T.canonical(lit(text)))) == want


def test_token_f1(spark):
    a, b = (F.array(*map(lit, x)) for x in (("алиготе", "баррель", "2024"), ("алиготе", "баррель", "2025")))
    assert one(spark, T.token_f1(a, b)) == pytest.approx(2 / 3)
    assert one(spark, T.token_f1(a, F.array().cast("array<string>"))) == 0


def test_repair_scripts(spark):
    got = one(spark, T.repair_scripts(lit("ФАНАГ0РИЯ Сапeрави сyхое 1OO Blanc Merlot 13,5%")))
    assert got == "фанагория саперави сухое 100 blanc merlot 13,5%"


def test_label_attributes(spark):
    text = T.canonical(lit("Каберне Совиньон 2019 2021 100% 13,5% белое"))
    assert one(spark, T.label_year(text)) is None
    assert one(spark, T.label_strength(text)) == 13.5
    assert one(spark, T.label_colour(text)) == "Белое"
    assert one(spark, T.longest_hits(text, ["совиньон", "каберне совиньон", "мерло"])) == ["каберне совиньон"]
    assert one(spark, T.label_year(T.canonical(lit("основано в 1878, урожай 2020")))) == "2020"


def test_sweetness(spark):
    assert one(spark, T.sweetness_code(lit("x-polusuhoe-12"))) == "polusuhoe"
    assert one(spark, T.sweetness_word(lit("вино полусладкое"))) == "polusladkoe"
    assert one(spark, T.slug_strength(lit("a-125"))) == 12.5
    assert one(spark, T.slug_strength(lit("a-1"))) is None


def test_fuzzy(spark):
    assert T.token_set_ratio("red ring", "red") == 100
    assert T.token_set_ratio("", "red") == 0
    assert one(spark, T.word_edit_distance(F.array(lit("a"), lit("b"), lit("c")), F.array(lit("a"), lit("x"), lit("c"), lit("d")))) == 2


def test_server_events():
    got = list(T.read_server_events(["event: a\nda", "ta: 1\n\ndata: 2\ndata: 3\n\ndata: open"]))
    assert got == [("a", "1"), ("message", "2\n3")]


def test_arrays(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, A.unit(v)) == [0.6, 0.8]
    assert one(spark, A.unit(F.array(F.lit(0.0)))) is None
    assert one(spark, A.hamming(F.lit(0b1010), F.lit(0b0011))) == 2
    assert one(spark, A.ratio(F.lit(1), F.lit(0))) is None


def test_geometry(spark):
    box = lambda *c: G.Box(*(F.lit(x) for x in c))
    a = box(0, 0, 100, 100)
    assert one(spark, G.retention(a, box(50, 0, 150, 100))) == 0.5
    assert one(spark, G.iou(a, box(50, 0, 150, 100))) == pytest.approx(5000 / 15000)
    assert [one(spark, c) for c in G.center_square(F.lit(1950), F.lit(7371))] == [0, 2710, 1950, 4660]
    assert [one(spark, c) for c in G.Box.parsed(lit("1,2,3,4"))] == [1, 2, 3, 4]
    assert all(one(spark, c) is None for c in G.Box.parsed(lit("1,2,x,4"))) and one(spark, G.Box.parsed(lit("1,2,3")).x0) is None
