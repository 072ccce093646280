"""Disguises of different kinds in one identifier."""

import pytest

from lobspark.llm import pii

MAILS = [
    "john (at) example dot com", "john at example (dot) com", "john@example dot com", "john At example Dot com", "john @ example dot co dot uk",
    "john\uff08at\uff09example\uff08dot\uff09com", "john (\u0430t) example d\u043et com", "john [at] mail.example dot com", "j\u043ehn\u00a0at\u00a0example\u200b dot com",
    "john (at) example\u3000dot\u3000com", "john&#64;example dot com", "john AT example [DOT] com", "john.doe (at) mail (dot) example dot com",
]
PHONES = [
    "plus\u00a0four\u00a0four\u00a0two\u00a0zero\u00a0seven\u00a0nine\u00a0four\u00a0six\u00a0zero",
    "plus four four \u200btwo\u200b zero s\u0435ven nine four six zero",
    "plus four\u200bfour two zero seven nine four six zero",
]


@pytest.mark.parametrize("mail", MAILS)
def test_mails(mail):
    text = f"write to {mail} soon"
    assert pii.spans(text)[1] == [(0, 9, 9 + len(mail))]
    assert pii.redact(text) == "write to <EMAIL> soon"


@pytest.mark.parametrize("phone", PHONES)
def test_phones(phone):
    assert pii.redact(f"call {phone}, please") == "call <PHONE>, please"


def test_cards():
    card = "four one one one one one one one one one one one one one one one".split()
    for between in (" ", "\u200b", "\u00a0", " \u2060"):
        assert pii.redact(f"card {between.join(card)}!") == "card <CARD>!"


@pytest.mark.parametrize("prose", ["meet me at example.com today", "look at the dot there", "we met at noon (dot) then"])
def test_prose_stays(prose):
    assert pii.redact(prose) == prose


def test_numbers_after_plus_and_unusual_labels():
    found = lambda t: [t[s:e] for _, s, e in pii.spans(t)[1]]
    assert found("call plus 1 four one five 555 0199 now") == ["plus 1 four one five 555 0199"]
    assert found("write john.doe at mail dot software today") == ["john.doe at mail dot software"]
    assert found("look at the dot there") == [] and found("two plus 2 is four, and one more") == []
