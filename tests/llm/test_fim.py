from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import fim

WORDS = st.text(alphabet=st.sampled_from("ab<PSM>é漢\U0001f600 \n"), max_size=40)


def plainly(text: str | None, doc_id):
    """The contract by slices of strings."""
    text = text or ""
    digits = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@given(WORDS, st.integers(0, 3000))
@settings(max_examples=400, deadline=None)
def test_output_and_way_back(text, doc_id):
    _, n, form, first, middle, output = plainly(text, doc_id)
    h = fim.draws("1", doc_id)
    assert fim.form_of(text, h) == form
    made = fim.transform(text, form, *fim.cuts(n, h))
    assert made.decode() == output and fim.restore(made, form) == text


@given(WORDS.filter(lambda t: not any(s in t for s in ("<P>", "<S>", "<M>"))), st.integers(0, 40), st.integers(0, 40), st.sampled_from([fim.PSM, fim.SPM]))
@settings(max_examples=300, deadline=None)
def test_every_cut_comes_back(text, a, b, form):
    first, second = sorted((min(a, len(text)), min(b, len(text))))
    assert fim.restore(fim.transform(text, form, first, second), form) == text


@given(st.binary(max_size=30), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
def test_rotation(data, x, y, z):
    i, j, k = sorted(min(v, len(data)) for v in (x, y, z))
    buffer = bytearray(data)
    fim.rotate(buffer, i, j, k)
    assert bytes(buffer) == data[:i] + data[j:k] + data[i:j] + data[k:]
    fim.rotate(buffer, i, i + k - j, k)
    assert bytes(buffer) == data


def test_table(spark):
    texts = [None, "", "a", "with <P> inside", "ünï漢\U0001f600 text " * 3, "x" * 300_000 + "é", "same", "same"] + [f"text number {i}, é" for i in range(60)]
    rows = [(i if i != 7 else 6, t, "other", 1) for i, t in enumerate(texts)] + [(None, "no id", "o", 2), (-5, "below zero", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    found = sorted((tuple(r) for r in fim.digests(docs).collect()), key=str)
    wanted = []
    for doc_id, text, *_ in rows:
        *start, output = plainly(text, doc_id)
        wanted.append((*start, sha256(output.encode()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    outputs = {(r.doc_id, r.output) for r in fim.transformed(docs).collect()}
    assert outputs == {(i, plainly(t, i)[-1]) for i, t, *_ in rows}


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
