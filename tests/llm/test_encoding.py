import random

import pytest

from lodestone.llm import encoding as e

DE = "für über größere Änderung natürlich prüft gelöscht nächste während Straße zurück später können müssen gültig höher".split()
FR = "modifié été côté réponse dernière très être où français requête d’éviter l’index œuvre déplacé précédente clé".split()
RU = "новая файл запуска ошибка каждый между есть поэтому старые проверка содержит завтра ключ версия шаг поиск импорт".split()
EN = "the a of stage “stale” — can’t café naïve 10 µs €40 → … it’s chunks run logs".split()


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(rng.choice([DE, FR, RU, EN, EN]), k=30)) + "." for _ in range(n)]


MODEL = e.train(_texts(800))


@pytest.mark.parametrize("chain", [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1)])
def test_exact_round_trip_of_utf8_chains(chain):
    for t in _texts(40, 2):
        bad = e.garble(t, chain)
        assert e.invert(bad, chain) == t
        if bad != t:
            assert e.repair(MODEL, bad)[1] == t


@pytest.mark.parametrize("chain,words", [(("cp1252", "mac_roman", 1), DE), (("mac_roman", "cp1252", 1), FR), (("cp1252", "cp437", 1), FR), (("cp1251", "koi8-r", 1), RU), (("koi8-r", "cp1251", 1), RU), (("cp866", "cp1251", 1), RU), (("cp1251", "cp1252", 1), RU)])
def test_single_byte_chains(chain, words):
    rng = random.Random(3)
    found = sum(e.repair(MODEL, e.garble(" ".join(rng.choices(words, k=25)), chain)) is not None for _ in range(20))
    assert found >= 18


def test_clean_and_odd_texts_are_left():
    flagged = [t for t in _texts(300, 4) if e.repair(MODEL, t)]
    assert flagged == []
    for t in ["", " ", "plain", "GRÖSSERE ÄNDERUNG", "👩‍💻 ✅", "عربي", "±6 m² «»", "NFD: é", "│├──"]:
        assert e.repair(MODEL, t) is None, t


def test_lost_characters_and_part():
    chain, text, whole = e.repair(MODEL, "gr��ere Stra�e")
    assert chain == "lost" and not whole
    half = "für über größere\n" + e.garble("während können zurück", ("utf-8", "cp1252", 1))
    assert e.repair(MODEL, half)[1] == "für über größere\nwährend können zurück"


def test_frame(spark):
    texts = _texts(300)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, "ascii", "x"), (None, texts[0], "x")]
    bad = e.garble("für über größere Änderung natürlich prüft", ("utf-8", "latin-1", 1))
    rows += [(2000, bad, "x"), (2001, bad, "y"), (2001, bad, "y"), (2002, bad + " Ã\n" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chain string")
    got = {r.doc_id: r for r in e.garbled_documents(df).collect()}
    assert set(got) == {2000, 2001, 2002} and got[2000].restored == "für über größere Änderung natürlich prüft" and got[2000].whole
    assert e.garbled_documents(df.limit(0)).collect() == []
    assert e.garbled_documents(df.where("doc_id = 1002")).collect() == []
