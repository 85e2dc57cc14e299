import random

import pytest
from grovetag.functions import encoding, phonetics
from pyspark.sql import functions as F

WORDS = "honda hyundai verna widget gizmo anvil bolt small anjelo gear plate ring rod economy standard promo michael schmidt thomas wright knight character chianti caesar czerny accident bacchus success edge dumb laugh ghost tagliaro ranger jose sugar island school schermer nation church witz filipowicz xavier breaux zhao pizza school bridge aggie cough mchugh gnome pneumonia".split()


def vocabulary():
    rng = random.Random(1)
    return WORDS + ["".join(rng.choice(["th", "er", "on", "sch", "an", "re", "ti", "gh", "ch", "mn", "rz", "ei", "c", "j", "wi", "x", "z", "ng"]) for _ in range(rng.randint(2, 5))) for _ in range(300)]


def test_daitch_mokotoff(spark):
    codec = spark._jvm.org.apache.commons.codec.language.DaitchMokotoffSoundex()
    for w in vocabulary():
        assert set(phonetics.daitch_mokotoff(w)) == set(codec.soundex(w).split("|")), w


def test_double_metaphone(spark):
    codec = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    codec.setMaxCodeLen(6)
    wrong = [(w, phonetics.double_metaphone(w), (codec.doubleMetaphone(w), codec.doubleMetaphone(w, True))) for w in vocabulary() if phonetics.double_metaphone(w) != (codec.doubleMetaphone(w), codec.doubleMetaphone(w, True))]
    assert not wrong, wrong[:20]


def test_beider_morse(spark):
    bm = spark._jvm.org.apache.commons.codec.language.bm
    engine = bm.PhoneticEngine(bm.NameType.GENERIC, bm.RuleType.APPROX, True)
    langs = spark._jvm.org.apache.commons.codec.language.bm.Languages.ANY_LANGUAGE
    wrong = []
    for w in vocabulary()[:120]:
        want = set(engine.encode(w, langs).split("|")) - {""}
        if set(phonetics.beider_morse(w)) != want:
            wrong.append((w, phonetics.beider_morse(w), sorted(want)))
    assert not wrong, wrong[:5]


def test_refined_soundex(spark):
    codec = spark._jvm.org.apache.commons.codec.language.RefinedSoundex()
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", encoding.refined_soundex(F.col("w")).alias("s")).collect()
    assert all(r["s"] == codec.soundex(r["w"]) for r in rows)


def test_vocabulary(spark):
    rows = phonetics.encode_vocabulary(spark.createDataFrame([("honda",), ("honda",), ("12",), ("ab",)], "token string")).collect()
    assert {r["token"] for r in rows} == {"honda"} and {r["kind"] for r in rows} == {"ds", "dm", "bm"}
    assert pytest.approx(len([r for r in rows if r["kind"] == "ds"])) == 1
