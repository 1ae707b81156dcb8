from __future__ import annotations

import random

import pytest

from lorequarry.llm import wrapper as W

PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><header>top</header><nav><ul>{items}</ul></nav><!-- <p>no</p> -->"
    "<div class='cookie-notice'>notice</div><main><article><h1>{title}</h1>{body}<div class=\"ad\">buy</div><form><input>send</form><section id='comments'><p>first</p></section></article></main>"
    "<aside>side</aside><footer>&copy; foot</footer></body></html>"
)


def page(title="T", body="<p>x</p>", items="<li>a</li><li>b</li>"):
    return PAGE.replace("{title}", title).replace("{body}", body).replace("{items}", items)


def shown(p):
    return W.show(W.skeleton(W.well_formed(W.tokens(p))))


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>one</p><p>two</p>", "one two"), ("<p>a<b>b</b>c<br>d", "abc d"), ("<p>a &amp; b&nbsp;&nbsp;c\n\n d</p>", "a & b c d"), ("<ul><li>x<li>y</ul>", "x y"), ("", ""), ("<p>a &lt;p&gt;</p>", "a <p>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<p>a<script>x</script>b</p>", "a b"), ("text <i>only</i>", "text only"), ("<p>open <p>again", "open again"),
    ],
)
def test_main_text(body, text):
    want = f"T {text}".strip()
    assert W.extract(page(body=body), "") == want
    assert W.extract(page(body=body), W.infer([shown(page()), shown(page(body="<p>1</p><p>2</p>"))])) == want


def test_odd_pages():
    assert W.extract("", "") == "" and W.extract("plain  text", "") == "plain text"
    assert W.extract("<p>a</p><div>b</div>", "") == "a b"
    assert W.extract("<body><nav>n</nav><p>a</p>", "") == "a"
    assert W.extract("<article>a", W.infer([shown("<body><p>x</p></body>")])) == "a"
    assert W.extract("<body><p>x</p></body>", W.infer([shown("<article>a</article>")])) == "x"
    assert W.extract("<article><p>a</p><div class='commentsWrap'><p>b</p></div><div id=sidebarLeft>c</div></article>", "") == "a"
    assert W.extract("<article><p>a</p><div role=navigation>b</div><div aria-hidden=true>c</div><p class=lead>d</p></article>", "") == "a d"
    assert W.extract("<<<>>> < a <", "")
    assert W.extract("<article>" + "<div>" * 400 + "deep", "") == "deep"


def test_folding_finds_repeated_groups():
    one = W.fold(("<ul", "<li", "#", ">li", "<li", "#", ">li", "<li", "#", ">li", ">ul"))
    assert one == ("<ul", ("*", ("<li", "#", ">li")), ">ul")
    nested = W.fold(("<a", "<b", ">b", "<b", ">b", ">a", "<a", "<b", ">b", "<b", ">b", ">a"))
    assert nested == (("*", ("<a", ("*", ("<b", ">b")), ">a")),)
    assert W.read(W.show(nested)) == nested and W.read("") == ()


def test_wrappers_are_union_free_and_match_their_pages():
    pages = [page(), page(body="<p>a</p><p>b</p><p>c</p>"), page(body="<h2>h</h2><p>a</p>"), page(body="<p>a<b>b</b></p>", items=""), page(body="")]
    layouts = [shown(p) for p in pages]
    wrapper = W.infer(layouts)
    assert "|" not in wrapper
    word = [list(W.flat(W.read(x))) for x in layouts]
    assert all(len(w) in W.ends(W.read(wrapper), w, {0}) for w in word)
    assert W.infer(list(reversed(layouts))) == W.infer(layouts * 2) == wrapper
    assert all(W.extract(p, wrapper) == W.extract(p, "") for p in pages)


def test_expressions():
    items = (("*", ("<a", ("?", ("#",)), ">a")), ("?", ("<b", ">b")))
    ok = lambda s: len(s.split()) in W.ends(items, s.split(), {0})
    assert ok("<a >a") and ok("<a # >a <a >a <b >b") and not ok("") and not ok("<b >b") and not ok("<a # # >a")


def test_table(spark):
    rows = [(1, "http://A.com/x", page("A")), (2, "https://u@a.com:80/y", page("B", "<p>q</p><p>r</p>")), (3, None, None), (4, "bad url", "<p>z</p>"), (1, "http://a.com/x", page("A")), (5, "http://b.org", "")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    known = W.wrappers(frame)
    assert sorted(r["host"] for r in known.collect()) == ["", "a.com", "b.org"]
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in W.main_texts(frame).collect())
    want = {1: "A x", 2: "B q r", 3: "", 4: "z", 5: ""}
    assert got == sorted((i, u or "", want[i], len(want[i])) for i, u, _ in rows)
    assert W.main_texts(frame.limit(0)).count() == 0


def test_host_that_mixes_pages_with_and_without_body(spark):
    pages = ["<html><body><nav>n</nav><p>a</p></body></html>", "<nav>n</nav><p>b</p>", "<div><p>c</p></div>", "plain", "<body><p>d</p>"]
    wrapper = W.infer([shown(p) for p in pages])
    assert W.Wrapper(wrapper).main == "body"
    assert [W.extract(p, wrapper) for p in pages] == ["a", "b", "c", "plain", "d"]
    frame = spark.createDataFrame([(k, "no url", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in W.main_texts(frame).orderBy("page_id").collect()] == [("a", 1), ("b", 1), ("c", 1), ("plain", 5), ("d", 1)]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 30])
def test_nothing_of_an_article_is_left_out(spark, n):
    """What all pages of a host say inside the article is text all the same, however many pages there are."""
    body = "<body><nav>n</nav><article><h1>T{0}</h1><p>By Jane Doe</p><p>text number {0}</p><p>Paris is the capital of France.</p></article></body>"
    frame = spark.createDataFrame([(k, f"http://a.com/{k}", body.format(k)) for k in range(n)], "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in W.main_texts(frame).collect()} == {k: f"T{k} By Jane Doe text number {k} Paris is the capital of France." for k in range(n)}


def test_names_inside_an_article_count_whole_only():
    kept = "<section class='discussion'>a</section><div class='related work'>b</div><div class='share-price'>c</div><p class='form-of-life'>d</p><header><h1>e</h1></header><p class=commentary>f</p>"
    lost = "<div class='ad'>no</div><section id=comments>no</section><nav>no</nav><form>no</form><div role=search>no</div><div class='x comments'>no</div><footer>no</footer>"
    pages = [f"<body><header>no</header><article>{kept}{lost}<p>g{k}</p></article></body>" for k in range(3)]
    wrapper = W.infer([shown(p) for p in pages])
    for regions in ((), W.Wrapper(wrapper).landmarks()):
        assert [W.extract(p, wrapper, regions) for p in pages] == [f"a b c d e f g{k}" for k in range(3)]
    assert W.extract("<body><div class='share-price'>no</div><p>yes</p></body>", "") == "yes"


def test_wide_runs_are_folded():
    part = tuple(x for k in range(40) for x in (f"<t{k}", "#", f">t{k}"))
    assert W.fold(part * 3) == (("*", part),)
    assert W.fold(("<a", *part * 2, ">a")) == ("<a", ("*", part), ">a")


def site(rng, hosts=6, least=2, most=12):
    """Pages without article or telling names: menus, notes and teasers that vary little or not, and the text somewhere."""
    rows = []
    for h in range(hosts):
        name = lambda: f"class={rng.choice('qxzvj')}{rng.randrange(99)}"  # noqa: E731, B023
        a, b, c, d = (name() for _ in range(4))
        deep = rng.choice([("", ""), (f"<div {name()}>", "</div>"), (f"<table {name()}><tr><td>", "</td></tr></table>")])
        for k in range(rng.randrange(least, most)):
            own = [f"title {h} {k}", *(f"own text of some length {h} {k} {j} {rng.randrange(999)}" for j in range(rng.randrange(2, 6)))]
            always = f"host {h} says this always"
            body = f"<h2>{own[0]}</h2><p>{always}</p>" + "".join(f"<p>{t}</p>" for t in own[1:])
            page_html = (
                f"<html><head><title>{k}</title><script>var k={k}{k}{k}{k};</script></head><body><div {a}><span>menu {h}</span></div><div {b}><ul><li>teaser {k % 3}</li></ul></div>"
                f"{deep[0]}<div {c}>{body}</div>{deep[1]}<div {d}><b>end {h}</b></div></body></html>"
            )
            rows.append((f"http://h{h}.org/{k}", page_html, " ".join([own[0], always, *own[1:]])))
    return rows


def test_only_the_wrapper_finds_the_text(spark):
    """The ablation: with an empty wrapper every page gets what is around its text as well."""
    rows = site(random.Random(4))
    frame = spark.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in W.main_texts(frame).collect()}
    assert all(got[k] == text for k, (*_, text) in enumerate(rows))
    assert not any(W.extract(p, "") == text for _, p, text in rows)


def test_a_host_of_one_page_or_of_copies_is_read_by_itself(spark):
    (url, html, _), *_ = site(random.Random(5), hosts=1)
    for rows in ([(1, url, html)], [(k, url, html) for k in range(9)]):
        found = W.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r["text"] for r in found} == {W.extract(html, "")}


def test_variation_against_brute_force(spark):
    rows = site(random.Random(6)) + [("http://h0.org/odd", "<p>odd</p>", ""), ("http://lone.org", "<div><p>a</p></div>", "")]
    frame = spark.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    known = W.wrappers(frame)
    found = {r["host"]: {x["slot"]: x["chars"] for x in r["slots"]} for r in W.variation(frame, known.select("host", "wrapper")).collect()}
    for r in known.collect():
        use, texts = W.Wrapper(r["wrapper"]), {}
        for url, p, _ in rows:
            if url.split("/")[2] == r["host"]:
                stream, own = W.well_formed(W.tokens(p)), {}
                for k, state in sorted(use.slots(stream).items()):
                    if stream[k][0] == W.TEXT:
                        own.setdefault(state, []).append(stream[k][1])
                for state, of_page in own.items():
                    texts.setdefault(state, []).append(of_page)
        assert found.get(r["host"], {}) == {s: sum(len(t) for of_page in x for t in of_page) for s, x in texts.items() if len(set(map(tuple, x))) > 1}
        # an element's states are those of its symbols and of nothing else
        for n in use.outline():
            inner = [use.states[k][0] for k in range(n.high, n.low - 1, -1) if use.states[k][0]]
            assert inner[0] == n.symbol and inner[-1] == ">" + n.symbol[1:].split(" ")[0] and sum(x[0] == "<" and x[1:].split(" ")[0] not in W.VOID for x in inner) == sum(x[0] == ">" for x in inner)


def test_an_odd_layout_takes_nothing_from_the_others(spark, monkeypatch):
    monkeypatch.setattr(W, "WRAPPER_SYMBOLS", 60)
    rows = site(random.Random(7), hosts=1, least=6, most=7)
    odd = "<body>" + "".join(f"<h{1 + k % 6}>o{k}</h{1 + k % 6}><ul><li>x</ul>" for k in range(40)) + "</body>"
    frame = spark.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate([*rows, ("http://h0.org/odd", odd, "")])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in W.main_texts(frame).collect()}
    assert all(got[k] == text for k, (*_, text) in enumerate(rows)) and got[len(rows)] == W.extract(odd, "")


def test_a_hot_host_with_very_many_layouts(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 16)
    rng = random.Random(6)
    parts = ["<h2>h</h2>", "<ul><li>a</li><li>b</li></ul>", "<table><tr><td>1</td></tr></table>", "<p>x<b>y</b></p>", "<blockquote>q</blockquote>", "<hr>", "<pre>c</pre>", "<h3>i</h3>", "<dl><dt>d</dt></dl>", "<h4>j</h4>", "<p>z<i>w</i></p>"]
    pages = [f"<article><h1>t{k}</h1>" + "".join(p for p in parts if rng.random() < 0.5) + "</article>" for k in range(1500)]
    assert len({shown(p) for p in pages}) > 900
    frame = spark.createDataFrame([(k, "http://hot.org/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(8)
    (known,) = W.wrappers(frame).collect()
    whole = W.Wrapper(known["wrapper"])
    assert 0 < len(list(W.flat(whole.items))) < 750  # optional parts, and not a list of more than 900 layouts
    assert all(whole.matches(W.skeleton(W.well_formed(W.tokens(p)))) for p in pages)
    got = {r["page_id"]: r["text"] for r in W.main_texts(frame).collect()}
    assert all(got[k].startswith(f"t{k}") for k in range(len(pages)))


def test_a_host_without_a_common_layout(spark):
    rng = random.Random(7)
    parts = ["<h2>h</h2>", "<ul><li>a</li></ul>", "<p>x<b>y</b></p>", "<blockquote>q</blockquote>", "<pre>c</pre>"]
    pages = ["<article>" + "".join(rng.choice(parts) for _ in range(250)) + "</article>" for _ in range(12)]
    wrapper = W.infer([shown(p) for p in pages])
    assert 0 < len(list(W.flat(W.read(wrapper)))) <= W.WRAPPER_SYMBOLS and W.infer([shown(p) for p in reversed(pages)]) == wrapper
    frame = spark.createDataFrame([(k, None, p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in W.main_texts(frame).collect()} == {k: W.extract(p, "") for k, p in enumerate(pages)}


def test_a_very_long_page(spark):
    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(20_000)) + "</article>"
    frame = spark.createDataFrame([(1, "http://l.org", long)], "page_id long, url string, html string")
    assert W.main_texts(frame).first()["text"] == " ".join(f"paragraph {k}" for k in range(20_000))


def templates(n: int, pages: int, parts: int = 450) -> list[tuple[str, str]]:
    """Pages of one host without telling elements or names, with their texts. Any two of the n templates are too long for one wrapper."""
    out = []
    for t in range(n):
        rng = random.Random(100 + t)
        menu = "".join(f"<{tag}>menu</{tag}>" for tag in (rng.choice(["h2", "h3", "h4", "h5", "pre", "dl", "ul", "ol"]) for _ in range(parts)))
        for k in range(pages):
            own = [f"title {t} {k}", *(f"own text {t} {k} {j}" for j in range(3))]
            body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:])
            out.append((f"<html><body><div><p>{t}</p>{menu}</div><div>{body}</div></body></html>", " ".join(own)))
    return out


def test_every_layout_is_in_a_wrapper():
    layouts = [shown(p) for p, _ in templates(3, 1)]
    into = W.inferred(layouts)
    assert len(set(into.values())) == 3 and set(into) == set(layouts)
    assert all(W.Wrapper(into[x]).matches(W.read(x)) for x in layouts) and into[max(layouts)] == max(layouts)


@pytest.mark.parametrize("fan", [64, 2])
def test_what_does_not_fit_in_a_wrapper_gets_another(spark, monkeypatch, fan):
    """No page is read by itself for being beyond the symbols of one wrapper, nor where no task has all wrappers of a host."""
    monkeypatch.setattr(W, "FAN", fan)
    rows = [(p, text) for p, text in templates(4, 3)]
    frame = spark.createDataFrame([(k, f"http://a.com/{k}", p) for k, (p, _) in enumerate(rows)] + [(99, "http://b.com", "<p>b</p>")], "page_id long, url string, html string").repartition(3)
    found = W.main_texts(frame).collect()
    assert sorted(r["page_id"] for r in found) == [*range(len(rows)), 99]
    got = {r["page_id"]: r["text"] for r in found}
    assert got.pop(99) == "b" and got == {k: text for k, (_, text) in enumerate(rows)}
    assert not any(W.extract(p, "") == text for p, text in rows)
