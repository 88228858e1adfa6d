"""Disguises in the words of four languages, and prose that only looks like one."""

import pytest

from trialspark.llm import pii


@pytest.mark.parametrize(
    "text, kind",
    [
        ("bob at example dot berlin", "email"),
        ("write to bob at example dot gmbh.", "email"),
        ("bob arroba ejemplo punto com", "email"),
        ("ana.lopez [arroba] ejemplo [punto] es", "email"),
        ("marie arobase exemple point fr", "email"),
        ("hans at beispiel punkt de", "email"),
        ("hans punkt meier klammeraffe beispiel punkt de", "email"),
        ("10 dot 0 dot 0 dot one", "ip"),
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("uno nueve dos punto uno seis ocho punto cero punto uno", "ip"),
        ("eins null punkt null punkt null punkt eins", "ip"),
        ("plus one two zero two five five five zero one four three", "phone"),
        ("plus 49 30 1234567 8", "phone"),
        ("plus vier neun drei null eins zwei drei vier fünf sechs", "phone"),
        ("plus trois trois un quatre deux zéro un deux trois quatre", "phone"),
        ("más tres cuatro seis uno dos tres cuatro cinco seis", "phone"),
        ("quatre" + " un" * 15, "card"),
        ("cuatro" + " uno" * 15, "card"),
        ("vier" + " eins" * 15, "card"),
    ],
)
def test_words_of_four_languages(text, kind):
    for front, back in (("", ""), ("¡", "."), ("siehe: ", "\nfin")):
        if front and text[-1] == ".":
            continue
        whole = front + text + back
        spans = pii.find_disguised(whole, pii.find(whole))[kind]
        assert len(spans) == 1 and abs(spans[0][0] - len(front)) <= max(0, text.find("bob")) and spans[0][1] <= len(front) + len(text), (whole, spans)


@pytest.mark.parametrize(
    "text",
    [
        "5 plus 3 is 8 and 4 plus 10 is 14", "water at boiling point in a pot", "un deux trois quatre, nous irons au bois", "look at her dot product.", "au point de vue", "er kam um acht, neun oder zehn",
        "dos y dos son cuatro", "to the point in question", "une fois, deux fois", "seis o siete", "at the dot", "at this point of time",
    ],
)
def test_prose_gains_nothing(text):
    assert not any(pii.find_disguised(text, pii.find(text)).values())
