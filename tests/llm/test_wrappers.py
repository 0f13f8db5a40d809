import random

import pytest

from catalogia.llm import wrappers

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randrange(8, 40))) + "."


def news(rng, k):
    """An article in <article>, unclosed tags, boilerplate around and inside."""
    paras = [prose(rng) for _ in range(rng.randrange(1, 6))]
    html = (
        f"<!DOCTYPE html><html><head><title>T {k}</title><script>var t='</p><article>no</article>'</script></head><body><header><h1>The Site</h1></header><nav><ul>"
        + "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample(WORDS, 4))
        + f"</ul></nav><!-- <p>gone</p> --><div class='ad'>{prose(rng)}</div><article class='post has-sidebar'><h1>Head &amp; {k}</h1>"
        + "".join(f"<p>{p.replace(' ', '  ', 1)}" + rng.choice(["</p>", "", "<br></p>"]) for p in paras)
        + f"<aside>{prose(rng)}</aside><div class='share-buttons'>Share</div></article><section id='comments'><p>{prose(rng, 80)}</p></section><footer>&copy; {k}</footer>"
    )
    return html, ["Head & " + str(k), *paras]


def divs(rng, k):
    """No tag names the article; the classes say nothing; some parts come and go."""
    paras = [prose(rng) for _ in range(rng.randrange(2, 7))]
    menu = "".join(f"<a class=x href='/{w}'>{w}</a> " for w in WORDS[:6])
    extra = rng.random() < 0.5
    body = "".join(f"<p>{p}</p>" + ("<ul><li>one thing</li><li>two things</li></ul>" if extra and i == 0 else "") for i, p in enumerate(paras))
    html = f"<html><body><div class='c1'>{menu}</div><div class='c2'>Always the same claim of this house</div><div class='c3'><div class='c4'><h2>Story {k}</h2>{body}</div></div><form><p>Your mail, please</p></form></body></html>"
    want = [f"Story {k}", paras[0], *(["one thing", "two things"] if extra else []), *paras[1:]]
    return html, want


def extracted(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    return {r.page_id: r.text for r in wrappers.main_texts(df, **more).collect()}


@pytest.mark.parametrize("small", [wrappers.SMALL_BYTES, 0])
def test_articles_of_unlike_hosts(spark, small, monkeypatch):
    monkeypatch.setattr(wrappers, "MERGED", 2)
    rng, pages, want = random.Random(1), [], {}
    for k in range(60):
        make = news if k % 3 else divs
        html, blocks = make(rng, k)
        pages.append((k, f"https://{make.__name__}.example.org/{k}", html))
        want[k] = "\n\n".join(blocks)
    assert extracted(spark, pages, small_bytes=small) == want


def test_one_host_with_two_kinds_of_pages(spark):
    rng, pages, want = random.Random(2), [], {}
    for k in range(40):
        html, blocks = (news if k % 4 else divs)(rng, k)
        pages.append((k, "http://both.example.org/", html))
        want[k] = "\n\n".join(blocks)
    got = extracted(spark, pages)
    assert {k: got[k] for k in got if k % 4} == {k: want[k] for k in want if k % 4}
    for k in range(0, 40, 4):  # the other template: whole article, and no menu, form or claim that all share
        assert all(b in got[k] for b in want[k].split("\n\n")) and "Your mail" not in got[k]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>in the deep</p>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>p {i}</p>" for i in range(20_000)) + "</article>"
    pages = [
        (1, None, None), (2, "", ""), (3, "no url", "just text &lt;b&gt; &amp"), (4, "http://deep.example/", deep), (5, "http://long.example/", long), (5, "http://long.example/", long),
        (None, "http://cut.example/", "<article><p>cut &quot;off&quot; &am</p><p>and <b>bo"), (6, "http://cut.example/", "<article><p>x<p class=\"unclosed>y</p></article><foot"),
        (7, "http://Copy.example:80/a", "<body><p>a copy of a page</p></body>"), (8, "http://copy.example/b", "<body><p>a copy of a page</p></body>"), (9, "http://user@copy.example/b", "<body><p>a copy of a page</p></body>"),
        (10, "http://list.example/", "<main><h1>Both</h1><dl><dt>a<dd>b<dt>c<dd>d</dl><table><tr><td>1<td>2<tr><td>3</table></main>"),
    ]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    rows = wrappers.main_texts(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == got[2] == "" and got[3] == "just text <b> &" and got[4] == "in the deep"
    assert got[5] == "\n\n".join(f"p {i}" for i in range(20_000))
    assert got[None] == 'cut "off" &am\n\nand bo' and got[6].startswith("x")
    assert got[7] == got[8] == got[9] == "a copy of a page"
    assert got[10] == "Both\n\na\n\nb\n\nc\n\nd\n\n1\n\n2\n\n3"
    assert wrappers.main_texts(df.limit(0)).collect() == []


def of(*pages):
    whole = None
    for p in pages:
        one = wrappers.wrapper_of(wrappers.parsed(p))
        whole = one if whole is None else wrappers.merged(whole, one, False)
    return wrappers.as_regex(whole)


def test_regular_expressions():
    assert of("<div><p>a</p></div>", "<div><p>b</p></div>") == "<div><p>#</></>"
    assert of("<div><p>a<p>b<p>c</div>") == "<div>(<p>#</>)+</>"
    assert of("<div><h1>t</h1><p>a</div>", "<div><p>b</div>") == "<div>(<h1>#</>)?<p>#</></>"
    assert of("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>(<dt>#</><dd>#</>)+</>"
    assert of("<ul></ul><p>a", "<p>b<ul></ul>") == "(<ul></><p>#</>)+"
    assert of("<p>x", "<p>x", "<p>x") == "<p>#=</>"
    same = [f"<div><h2>{k}</h2>" + "<p>x" * (k % 3) + "</div>" for k in range(9)]
    a, b, c = of(*same), of(*same[::-1]), of(*same[4:], *same[:4])
    assert a == b == c == "<div><h2>#</>(<p>#=</>)+</>"


def test_many_classes_stay_bounded():
    page = "<div>" + "".join(f"<p class='k{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}'>t{i}</p>" for i in range(900)) + "</div>"
    block = wrappers.parsed(page)
    wrapper = wrappers.wrapper_of(block)
    assert wrappers.size_of(wrapper) <= 10
    assert wrappers.Reader(wrapper).text(block).split("\n\n") == [f"t{i}" for i in range(900)]
