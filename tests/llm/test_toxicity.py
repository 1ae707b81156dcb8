from __future__ import annotations

import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lorequarry.llm import toxicity as X

SCHEMA = "doc_id long, text string, score string"


NAMES = {"insult": "i", "targeted": "y", "threat": "t", "plain": "", "reported": "r", "negated": "n"}


def machine(symbols: str) -> list[str | None]:
    """Events in short: pattern, then polarity."""
    return [e and NAMES[e[0]] + NAMES[e[1]] for e in map(X.event, X.grammar().run(list(symbols)))]


def test_grammar():
    assert machine("OIO") == [None, "i", None]
    assert machine("YOI") == [None, None, "y"]
    assert machine("NI") == [None, "in"] and machine("NOOOI")[-1] == "i"
    assert machine("RI") == [None, "ir"] and machine("QIQI") == [None, "ir", None, "i"]
    assert machine("RNI")[-1] == "in"
    assert machine("WVY") == [None, None, "t"] and machine("VY") == [None, None] and machine("WOOOVY")[-1] == "t" and machine("WOOOOVY")[-1] is None
    assert machine("RWVY")[-1] == "tr" and machine("NWVY")[-1] == "tn" and machine("YNI")[-1] == "yn"


def by_places(symbols: str) -> list[str | None]:
    """The patterns as conditions on places, without any state."""

    def last(kinds: str, before: int, within: int = 10**6) -> int | None:
        return next((j for j in range(before - 1, max(-1, before - 1 - within), -1) if symbols[j] in kinds), None)

    def polarity(i: int) -> str:
        if last("N", i, 3) is not None:
            return "n"
        return "r" if "R" in symbols[:i] or symbols[:i].count("Q") % 2 else ""

    threats: dict[int, str] = {}
    announced, verb = None, None  # places; a threat uses both up
    for i, s in enumerate(symbols):
        if s == "W":
            announced, verb = i, None
        elif s == "V" and (verb is not None and i - verb <= 4 or verb is None and announced is not None and i - announced <= 4):
            verb = i
        elif s == "Y" and verb is not None and i - verb <= 4:
            threats[i], announced, verb = polarity(verb), None, None
    out: list[str | None] = []
    for i, s in enumerate(symbols):
        if i in threats:
            out.append("t" + threats[i])
        elif s == "I":
            persons = [j for j in range(max(0, i - 3), i) if symbols[j] == "Y" and j not in threats]
            out.append(("y" if persons else "i") + polarity(i))
        else:
            out.append(None)
    return out


@given(st.text(alphabet="IVWYNRQO", max_size=14))
def test_composed_machine_against_conditions_on_places(symbols):
    assert machine(symbols) == by_places(symbols)


def test_composition_passes_symbols_through():
    a = X.Transducer(0, lambda s, x: (s + 1, x * 2))
    b = X.Transducer(0, lambda s, x: (s + len(x), f"{x}{s}"))
    assert (a >> b).run(["p", "q"]) == ["pp0", "qq2"]


def model():
    return X.Model({"idiot": 6.0, "scum": 6.0}, X.PRIOR, X.BASE)


def test_scores_by_clause():
    m = model()
    plain, aimed, denied, told = (m.score(t) for t in ("the idiot went", "you idiot", "you are not an idiot", "he said idiot"))
    assert m.score("") == m.score("nothing here") == m.score("not. never! said") < 0.5
    assert aimed > plain > m.score("") > told > denied  # what is denied or told speaks against it
    assert m.score("he said idiot; the idiot went") > m.score("he said idiot")
    assert m.score("I will kill you") > 0.5 > m.score("I will see you. kill time") and m.score("I will not kill you") < 0.5
    assert m.score("idiot " * 50 + "scum!") > 0.99
    assert X.clause_kind([]) is None
    assert X.clause_kind([(("insult", "negated"), 9.0), (("threat", "plain"), 2.0), (("insult", "plain"), 3.0)]) == (X.KINDS.index(("threat", "plain")), 5.0)


def spoken(n=900, seed=3):
    """Toxic are insults and threats that are meant; denied or reported ones and harmless announcements are clean."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ba de ki lo mu ne so".split() for b in "ra se ti no ga".split()] + "the what and came a".split() * 3
    insults = ["zorgel", "varkin", "plimt"]
    bad = ["you {i}", "the {i} came", "what a {i} and {i}", "we will kill you", "i shall hurt them", "you {i} {i}"]
    good = ["you are not a {i}", "he said {i}", 'she wrote "{i} you {i}"', "never {i}", "we will see you", "they kill time", "i shall walk", "without {i}"]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        said = rng.choice(bad if toxic else good if k % 3 == 1 else ["{p}"]).replace("{p}", rng.choice(plain))
        while "{i}" in said:
            said = said.replace("{i}", rng.choice(insults), 1)
        filler = lambda: " ".join(rng.choice(plain) for _ in range(rng.randrange(1, 8)))
        docs.append((k, f"{filler()}. {said}. {filler()}", "x"))
        labels.append((k, int(toxic), 1))
    return docs, labels


def held_out_accuracy(spark, docs, labels):
    m = X.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    held = [k for k, (i, *_) in enumerate(docs) if zlib.crc32(str(i).encode()) % 5 == 0]
    return m, sum((m.score(docs[k][1]) >= 0.5) == bool(labels[k][1]) for k in held) / len(held)


def test_the_grammar_carries_the_accuracy(spark, monkeypatch):
    docs, labels = spoken()
    m, whole = held_out_accuracy(spark, docs, labels)
    assert whole >= 0.97 and m.weights[X.KINDS.index(("insult", "negated"))] < 0
    assert all(s.startswith(("zor", "var", "pli")) for s in m.stems)  # no chance stems
    # the identity in place of the composed machine: no threats, and what is denied or told counts as meant
    monkeypatch.setattr(X, "grammar", lambda: X.Transducer(0, lambda state, s: (state, s)))
    assert held_out_accuracy(spark, docs, labels)[1] <= whole - 0.15


def rows(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "ba de ki lo mu".split() for b in "ra se ti no".split() for c in "n s r l".split()]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["zorgel", "zorgelin", "zorgelax", "Vark!"]))
        docs.append((k, " ".join(text), "x"))
        labels.append((k, int(toxic), 1))
    return docs, labels


def test_learning_and_held_out_accuracy(spark):
    docs, labels = rows()
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    m = X.fit(d, y)
    assert any(s.startswith("zorgel") for s in m.stems) and "vark" in m.stems
    got = {r["doc_id"]: r["predicted"] for r in X.scored(d, m).collect()}
    assert sum(got[i] == t for i, t, _ in labels) >= 0.98 * len(labels)
    kept = {r["doc_id"] for r in X.kept(d, m).collect()}
    assert kept == {i for i, p in got.items() if not p} and X.kept(d, m).columns == d.columns


def test_held_out_labels_are_never_read(spark):
    docs, labels = rows(120)
    d = spark.createDataFrame(docs, SCHEMA)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    one, two = (X.fit(d, spark.createDataFrame(x, "doc_id long, toxic int, quality int")) for x in (labels, turned))
    assert one.stems == two.stems and one.base == two.base


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (None, 1)], [(1, 0), (1, 1), (2, 0)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "idiot"), (2, None), (3, ""), (3, ""), (None, "x" * 100_000)], "doc_id long, text string")
    m = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = X.scored(docs, m).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert X.scored(docs.limit(0), m).count() == 0


def test_one_id_with_different_texts(spark):
    docs, labels = rows(120)
    other = [(i, "zorgel " * 5 if not labels[i][1] else "nothing", "x") for i, *_ in docs[:40]]
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in ([*docs, *other], [*other, *docs])]
    y = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    one, two = (X.fit(f, y) for f in frames)
    assert one.stems == two.stems and one.base == pytest.approx(two.base) and X.scored(frames[0], one).count() == 160
