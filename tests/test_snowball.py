"""Stems against examples published with the algorithms."""

import pytest
from pyspark.sql import functions as F

from subjex.operators.snowball import english, german, snowball_stem

ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news inning inning proceed proceed generate generat generously generous communism communism
ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriating luxuri happy happi by by say say
relational relat vietnamization vietnam feudalism feudal sensibiliti sensibl hopefulness hope formaliti formal
adjustment adjust replacement replac adoption adopt controlling control roll roll youth youth boyish boyish"""
GERMAN = """aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg
aufeinanderfolgend aufeinanderfolg aufeinanderfolgende aufeinanderfolg aufeinanderfolgenden aufeinanderfolg
aufeinanderfolgt aufeinanderfolgt aufeinanderfolgten aufeinanderfolgt aufeinanderschlügen aufeinanderschlug
aufenthalt aufenthalt aufenthalten aufenthalt aufenthaltes aufenthalt auferlegen auferleg auferlegt auferlegt
auferlegten auferlegt auferstand auferstand auferstehen aufersteh aufersteht aufersteht auferstehung aufersteh
auferstünde auferstund auferwecken auferweck auferweckt auferweckt auferzogen auferzog aufessen aufess auffa auffa
auffallen auffall auffallend auffall auffallende auffall auffällig auffall auffälligen auffall auffälliges auffall
auffassen auffass auffasst auffasst auffaßt auffasst auffassung auffass auffassungsvermögen auffassungsvermog
kategorie kategori kategorien kategori kategorisch kategor kategorische kategor kategorischen kategor kater kat katers kat
käthchen kathch kathedrale kathedral kathinka kathinka katholik kathol katholische kathol kattun kattun
kattunhalstücher kattunhalstuch katz katz katze katz katzen katz katzensprung katzenspr katzenwürde katzenwurd
kätzin katzin kätzlein katzlein kauen kau kauerte kauert kauf kauf kaufen kauf käufer kauf kauffahrer kauffahr
kaufkraft kaufkraft käuflich kauflich kaufmann kaufmann kaufmanns kaufmann kaufmännisch kaufmann
kauft kauft kaufte kauft kaufvertrag kaufvertrag kaum kaum"""


@pytest.mark.parametrize("stem, words", [(english, ENGLISH), (german, GERMAN)])
def test_published_examples(stem, words):
    w = words.split()
    wrong = [(a, stem(a), b) for a, b in zip(w[::2], w[1::2]) if stem(a) != b]
    assert not wrong


def test_any_word_gets_a_stem():
    for w in ("", "a", "y", "yy", "'s", "''", "ss", "123", "x" * 10_000, "ß", "uuu", "aya"):
        assert isinstance(english(w), str) and isinstance(german(w), str)


def test_dictionary_stems_each_token_in_place(spark):
    from subjex.operators.preprocess import preprocess_fields
    df = spark.createDataFrame([(1, "The running Kneels knees", "en"), (2, "Die Katzen, Katzen kauften", "de"), (3, None, "de"), (4, "", None)],
                               "id int, text string, lang string")
    got = {r["id"]: r["pre"] for r in preprocess_fields(df, "id", {"pre": "text"}, "lang", stem=snowball_stem).collect()}
    assert got[1] == "run kneel knee" and got[2] == "katz katz kauft" and not got[3] and not got[4]


def test_registered_dictionary(spark):
    import __spark_entry__ as E
    from testdata_paths import SF_SMALL
    out = E.queries()["t4_snowball_terms"](spark, SF_SMALL)
    assert out.groupBy("lang", "token").count().where("count > 1").count() == 0
    assert all(snowball_stem(r["lang"], r["token"]) == r["term"] for r in out.orderBy(F.xxhash64("token")).limit(300).collect())


def test_stems_stay_in_the_row(spark):
    """No token becomes a row; repeated keys, missing texts and missing keys as before."""
    from subjex.operators.preprocess import preprocess_fields
    df = spark.createDataFrame([(1, "The running Kneels", "en"), (1, "Other words", "en"), (None, "Katzen", "de"), (2, None, "de"), (3, "", None)],
                               "id int, text string, lang string")
    out = preprocess_fields(df, "id", {"pre": "text"}, "lang", stem=snowball_stem, keep=())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert sorted(out.collect(), key=str) == sorted([(1, "run word kneel"), (None, "katz"), (2, ""), (3, "")], key=str)
