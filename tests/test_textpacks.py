"""Language rules, numbers and capitals by fixtures, a line each."""

import pytest

from voxframe.functions.numerals import LANGUAGES, small_numbers, spelled_to_digits
from voxframe.functions.text import capitalise
from voxframe.operators import textrules as tr

CASES = [
    ("elision", tr.ELISION_FR, "fr", "que Elle vient, la hyène, le hot dog, je happe, si il le Homme", "qu'elle vient, la hyène, le hot dog, j'happe, s'il l'homme"),
    ("elision keeps", tr.ELISION_FR, "fr", "la ONU de Un l'Europe que A", "l'ONU d'un l'Europe qu'A"),
    ("italian", [*tr.ITALIAN, *tr.ELISION_IT], "it", "Lo amico di il re, una ora, dove è, come era, QUELLO ALBERO, lo zio, ci hanno", "L'amico del re, un'ora, dov'è, com'era, Quell'ALBERO, lo zio, c'hanno"),
    ("spanish", tr.SPANISH, "es", "Dime, cuántos son? Por qué no?", "Dime, ¿cuántos son? ¿Por qué no?"),
    ("spanish marked", tr.SPANISH, "es", "¿Qué es? Hola. Bien!", "¡¿Qué es? Hola. Bien!"),
    ("spanish calls", tr.SPANISH, "es", "¡Hola. Bien! Ya voy! no", "¡Hola. Bien! ¡Ya voy! no"),
    ("portuguese", tr.PORTUGUESE, "pt", "em ele, Em elas, de aquilo", "nele, Nelas, daquilo"),
    ("dutch", tr.DUTCH, "nl", "Het huis in de avond en een man, Een Jan, in de nachts", "'t huis 's avonds en 'n man, Een Jan, 's nachts"),
    ("romanian", tr.ROMANIAN, "ro", 'nu am, Nu a, nu o, într o "zi"', "n-am, N-a, n-o, într-o „zi“"),
    ("dots", tr.TYPOGRAPHY_FR, "fr", "bon.... oui...", "bon… oui…"),
    ("versions", tr.VERSIONS, "fr", "trois point deux, une point dix point 4, un point de vue", "3.2, 1.10.4, un point de vue"),
    ("versions de", tr.VERSIONS, "de", "eine punkt zehn", "1.10"),
    ("versions pt", tr.VERSIONS, "pt", "duas ponto uma ponto dez", "2.1.10"),
    ("times", tr.TIME_FR, "fr", "23 heures 15, 3 heures 5, 7h30, 25 heures 10, 9 heures 61", "23h15, 03h05, 7h30, 25 heures 10, 9 heures 61"),
    ("equals", tr.EQUALS_FR, "fr", "4 égale 3, 4 égales 3, 2égal2", "4 = 3, 4 égales 3, 2=2"),
]


def test_language_rules(spark):
    for name, rules, lang, given, want in CASES:
        rows = spark.createDataFrame([(given, lang), (given, "xx")], "text string, lang string")
        got = [r.text for r in tr.rewrite(rows, rules).collect()]
        assert got == [want, given], name


def test_capitals(spark):
    cases = {
        "a. b\n\tc": "A. B\n\tC", "é!          oui… non?\x02 si": "É!          Oui… Non? Si", "x.y z": "X.y z", "1. a": "1. A", "": "",
        "a. b": "A. B", "\n\n a": "\n\n A", "Déjà. \n été": "Déjà. \n Été", "ok\x02 non": "Ok\x02 non",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in rows.select("t", capitalise(rows["t"]).alias("c")).collect()}
    assert got == cases


@pytest.mark.parametrize("lang", LANGUAGES)
def test_every_small_number_is_read(lang):
    forms = small_numbers(lang)
    assert set(forms.values()) == set(range(100))
    assert all(spelled_to_digits(f"x {w} x", lang) == f"x {n} x" for w, n in forms.items() if n > 1)


def test_spelled_numbers(spark):
    from pyspark.sql import functions as F

    cases = [
        ("en", "I have twenty-one cats and one dog", "I have 21 cats and one dog"), ("en", "two million five", "2000005"),
        ("en", "one hundred and five thousand three hundred twelve", "105312"), ("en", "two three four", "2 3 4"), ("en", "twenty, one", "20, one"),
        ("fr", "vingt et un ans, quatre-vingt-dix-sept euros, un point", "21 ans, 97 euros, un point"), ("fr", "deux cent trois mille quatre cents", "203400"),
        ("fr", "mille neuf cent quatre-vingt-quatre", "1984"), ("fr", "soixante et onze", "71"), ("de", "ein Haus, dreihundertfünfundvierzig", "ein Haus, 345"),
        ("de", "zweitausend vierundzwanzig", "2024"), ("es", "treinta y dos mil quinientos", "32500"), ("es", "veintidós y uno", "22 y uno"),
        ("pt", "cento e vinte e três", "123"), ("it", "duecentoquarantatré e ventuno", "243 e 21"), ("it", "tremila", "3000"),
        ("nl", "drieëntwintig en honderdvijf", "23 en 105"), ("xx", "two", "two"), ("en", "hundred and", "100 and"), ("en", None, None),
    ]
    from voxframe.functions.numerals import digits

    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, lang string, text string, want string")
    got = rows.select("k", "want", digits(F.col("text"), F.col("lang")).alias("got")).orderBy("k").collect()
    assert [r.got for r in got] == [r.want for r in got]
    chain = [("vingt-trois heures quinze ; trois égale trois ; deux point trois", "fr")]
    df = spark.createDataFrame(chain, "text string, lang string")
    only = dict(rules=False, script=False, continuation=False, language=False, typography=False, dictionary=False, capitals=False, short=False)
    assert tr.TextChain(tr.Gates(spelled=True, **only)).apply(df).first().text == "23h15 ; 3 = 3 ; 2.3"
    seen = tr.TextChain(tr.Gates(spelled=True, **only)).trace(df).first().trace
    assert [(r.label, r.after) for r in seen][1:3] == [("spelled", "23 heures 15 ; 3 égale 3 ; 2.3"), ("numbers", "23h15 ; 3 = 3 ; 2.3")]
    assert all(a.after == b.before for a, b in zip(seen, seen[1:], strict=False))
    assert tr.TextChain(tr.Gates(**only)).apply(df).first().text == "vingt-trois heures quinze ; trois égale trois ; 2.3"


def test_spaces_before_digits(spark):
    from voxframe.operators.sequence import digit_spacing

    cases = {"ab|12": "ab 12", "a|1": "a 1", "A|1": "A 1", "b|1": "b1", "x |1|2": "x 12", "é|t|5": "ét 5", "a.|7": "a.7", "a|1|b|2": "a 1b2", "ab| 3": "ab 3", "|ab||9": "ab 9"}
    rows = [(m, k, p) for m, pieces in enumerate(cases) for k, p in enumerate(pieces.split("|"))]
    got = digit_spacing(spark.createDataFrame(rows, "media_id long, pos int, piece string")).orderBy("media_id").collect()
    assert [r.text for r in got] == list(cases.values())
    import time

    long = spark.createDataFrame([(1, k, "ab" if k % 2 else "7") for k in range(60_000)], "media_id long, pos int, piece string")
    start = time.perf_counter()
    assert len(digit_spacing(long).first().text) > 100_000
    assert time.perf_counter() - start < 20
