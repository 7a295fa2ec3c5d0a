import random

import pytest

from textloom.llm import main_text as M

SCHEMA = "page_id long, url string, html string"
FRAME = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p><article>";</script></head><body class="has-sidebar"><header><h1>The site</h1></header><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News of the day</a></li></ul></nav><div class="teaser">Read on what others have found out lately.</div>{}<aside><p>Other pages that you may like to read.</p></aside><section id="comments"><p>I do not agree with any of this at all, not even a bit of it.</p><p>Me neither, so there are two of us who say so.</p></section><footer>&copy; us</footer></body></html>'


def page(content):
    return FRAME.format(f"<article>{content}</article>")


def training(n=40):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 8)))
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 40)))
    return [(i, f"u{i}", page(f"<h1>{text()}</h1>" + "".join(f"<p>{text()}" for _ in range(rng.randrange(1, 6))))) for i in range(n)]


def weights():
    inside, outside = {}, {}
    for _, _, h in training():
        for k, (a, b) in M.counts_of(h).items():
            inside[k], outside[k] = inside.get(k, 0) + a, outside.get(k, 0) + b
    return M.Weights({k: (inside[k], outside[k]) for k in inside})


CASES = {
    "blocks and phrases": ("<h1>A  title</h1><p>One <b>bo</b>ld\n word</p>\n<p>two<br>three&nbsp;four &lt;b&gt; &am &#65;", "A title One bold word two three four <b> &am A"),
    "unclosed and crossed tags": ("<p><b>One two three<p>four</i> five</b> six<ul><li>seven<li>eight</ul>", "One two three four five six seven eight"),
    "boilerplate within": ("<p>One two three</p><div class='ad-slot'>Buy it now</div><p>four five six</p><form><label>Your name</label><input></form><figure><figcaption>A view</figcaption></figure><p>seven eight nine</p><ul class='share'><li>Tell</ul>", "One two three four five six A view seven eight nine"),
    "an ending paragraph of a class": ("<p>One two three<p class=promo>Buy this<p>four five six", "One two three four five six"),
    "script, style, comment, attributes": ("<p title='a > b' data-x=\"<p>\">One two<!-- <p>no</p> --><script>if (a < b) '</p>'</script> three <SPAN>four</SPAN> 3 < 4 five", "One two three four 3 < 4 five"),
    "hidden": ("<p>One two three</p><p hidden>no</p><p style='display: none'>no</p><p>four five six", "One two three four five six"),
    "own heading": ("<header><h1>Title</h1></header><p>One two three four five six", "Title One two three four five six"),
    "links and tables": ("<p>One <a href=x>two three</a> four</p><table><tr><td>five<td>six</table>", "One two three four five six"),
}


@pytest.mark.parametrize("case", CASES)
def test_text_of_a_page(case):
    content, text = CASES[case]
    known = weights()
    assert M.extract(page(content), known) == text
    assert M.extract(FRAME.format(f'<div class="layout sidebar-left"><main>{content}</main></div>'), known) == text
    if case != "own heading":  # a header belongs to an article or to the page
        for wrapped in (f'<div class="post-body">{content}</div>', f"<div>{content}</div>"):
            assert M.extract(FRAME.format(wrapped), known) == text


def test_signs_of_weights():
    known = weights()
    assert all(known[k] <= 0 for k in list(known.known) if k.startswith("<")) and known["</article"] < known["</p"] <= 0
    assert known["p"] > 0 > known["div.teaser"]


def test_odd_pages():
    plain = M.Weights()
    assert [M.extract(p, plain) for p in ("", " ", "<", "<p", "<!--", "<!-- a", "<script>x", "<nav>a b", "</p></p>", "&amp")] == ["", "", "<", "", "", "", "", "", "", "&"]
    assert M.extract("one two", plain) == "one two"
    assert M.extract("<p>" * 20000 + "<b>" * 20000 + "word" + "<li>x" * 20000, plain).startswith("word x x")
    assert len(M.extract("<p>" + "long " * 300_000, plain)) == 5 * 300_000 - 1
    assert M.extract('<p a="' * 5000 + "x", plain) in ("", "x")


def test_best_run_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice((-2, -1, 0, 1, 2)) for _ in range(rng.randrange(9))]
        sums = [(sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        start, end = M.best_run(scores)
        assert sum(scores[start:end]) == max([0, *(s for s, _, _ in sums)])


def test_table_against_brute_force(spark, monkeypatch):
    rows = [*training(), (90, None, None), (91, "u", ""), (None, "u", FRAME.format("<div><p>alone it stands here")), *training(2), (92, "u", page(CASES["boilerplate within"][0]))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "'x' as TEXT", "2 as pages").repartition(3)
    counts = {}
    for _, _, h in rows:
        if h and h.count("<article>") == 2:  # one of them in the script
            for k, v in M.counts_of(h).items():
                counts.setdefault(k, []).append(v)
    known = M.Weights({k: tuple(map(sum, zip(*v, strict=True))) for k, v in counts.items() if len(v) >= M.MIN_PAGES})
    monkeypatch.setattr(M, "_CONTENT_TAG", r"(?is)<article[\s>](?!\")")
    found = M.main_text(df)
    assert found.columns == ["page_id", "url", "html", "key", "pages", "text", "n_chars"]
    texts = [M.extract(h or "", known) for _, _, h in rows]
    assert sorted((repr(r.page_id), r.text, r.n_chars, r.key, r.pages) for r in found.collect()) == sorted((repr(i), t, len(t), 1, 2) for (i, _, _), t in zip(rows, texts, strict=True))


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "u", FRAME.format("<p>One two three four"))], SCHEMA)
    assert M.main_text(df, keep=["page_id"]).first().text.endswith("One two three four")
    assert M.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sample_of_labelled_pages_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i, u, h.replace("<article>\";", "")) for i, u, h in training()], SCHEMA)
    monkeypatch.setattr(M, "MAX_LABELLED", 10)
    assert M.learn(df).known["p"] > 1
