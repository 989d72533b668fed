import itertools
import random
import unicodedata

import pytest

from tarnwork.llm.lookalike import LOOKALIKES, Transducer, alike_classes, alike_pairs, cluster_rules, conflicts, single_rules, transducer
from tests.conftest import rows

SAME = [
    ("Hello", "Ｈｅｌｌｏ"), ("café", "cafe\u0301"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("ab", "a\u200bb"), ("ab", "a\u00adb"), ("\ufeffab", "ab"), ("copy", "сору"), ("Ω\u0301x", "Ώx"), ("ёлка", "е\u0308лка"), ("NOT", "ΝΟΤ"),
    ("fine", "ﬁne"), ("e\u200b\u0301", "é"), ("ガ", "ｶﾞ"), ("⚠", "⚠\ufe0f"), ("q\u0323\u0307", "q\u0307\u0323"), ("ệ", "e\u0302\u0323"), ("ệ", "е\u200b\u0323\u2060\u0302"), ("가", "\u1100\u1161"), ("Ѵүɡ", "Vyg"), ("ϲϹ", "cC"), ("ПΓκ", "ΠГк"), ("\ue000a", "\ue000\u200ba"), ("𝐞\u0301", "é"),
]
DIFFERENT = [("a b", "a  b"), ("a\nb", "a b"), ("a\nb", "a\r\nb"), ("A", "a"), ("e", "é"), ("и", "й"), ("1", "l"), ("O", "0"), ("rn", "m"), ("👩\u200d💻", "👩💻"), ("ß", "ss"), ("a\tb", "a b"), ("\ue000", "\u200d"), ("a\ue000b", "ab")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    t = transducer()
    assert t.apply(a) == t.apply(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    t = transducer()
    assert t.apply(a) != t.apply(b)


def test_rules_are_consistent():
    m = {c: new for c, new, _ in reversed(single_rules())}
    assert m["а"] == "a" and m["ａ"] == "a" and m["ϲ"] == "c" and m["Ϲ"] == "C" and "é" not in m
    assert ("e\u0301", "é", "accent") in cluster_rules() and ("ｅ\u0301", "é", "accent") in cluster_rules() and ("е\u0301", "é", "accent") in cluster_rules()
    assert conflicts([*single_rules(), *cluster_rules()]) == []
    assert conflicts([("x", "y", "one"), ("x", "z", "two"), ("x", "y", "three")]) == [(("x", "y", "one"), ("x", "z", "two"))]
    with pytest.raises(ValueError, match="disagree"):
        Transducer([*single_rules(), ("а", "o", "mistake")])
    with pytest.raises(ValueError, match="again"):
        Transducer([("ä", "ö", "a"), ("ö", "o", "b")])
    random.seed(6)
    t = transducer()
    alphabet = "abé и\u0301\u0308\u200bａｂ\u00a0ﬁ" + "".join(LOOKALIKES)
    for _ in range(500):
        x = "".join(random.choice(alphabet) for _ in range(12))
        once = t.apply(x)
        assert t.apply(once) == once and once == unicodedata.normalize("NFC", once) and t.apply(unicodedata.normalize("NFD", x)) == once
    assert t.apply(None) is None and t.apply("") == ""


def test_pairs_equal_brute_force(spark):
    t = transducer()
    texts = [None, "", "  ", "\u200b", "\u00a0", "copy", "сору", "copy", "с\u200bopy", "other", "ＯＫ it is", "OK it is", "OK  it is", "x" * 100_000, "х" * 100_000] + ["hot"] * 60 + ["hоt"]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id bigint, text string, form string")
    shown = [i for i, x in enumerate(texts) if x and t.apply(x).strip()]
    want = sorted([(a, b) for a, b in itertools.combinations(shown, 2) if texts[a] != texts[b] and t.apply(texts[a]) == t.apply(texts[b])], key=str)
    assert rows(alike_pairs(df, "doc_id", "text")) == want and len(want) > 60
    assert alike_pairs(df.where("1=0"), "doc_id", "text").count() == 0
    groups = {}
    for i in shown:
        groups.setdefault(t.apply(texts[i]), []).append(i)
    members = [(i, min(g), len(g)) for g in groups.values() if len({texts[i] for i in g}) > 1 for i in g]
    assert rows(alike_classes(df.unionByName(df), "doc_id", "text"), "doc_id", "class_id", "docs") == sorted(members, key=str)
