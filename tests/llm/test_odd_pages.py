"""Pages written by hand that the labelled ones don't hold: signs of rights in the text, no tags, odd comments; a § begins each block that is content."""

from __future__ import annotations

from oreflow.llm import html_extraction

PAGES = [
    "<article><h1>§A small press</h1><p>§It began in a shed with one machine.</p><p>§Orders came slowly at first.</p><p>§&copy; 2020 was printed on the first page of it.</p></article>",
    "<html><body><main><h1>§Marks</h1><p>§© is a letter in a ring, and few know who drew it first.</p><p>§™ came later, when trade had spread over the sea.</p></main><footer>© 2011 Ring Press. All rights reserved.</footer></body></html>",
    "§A page that was sent as plain text, as some old servers still do, with no tag in it.",
    "§One line",
    "<!-->§The first words stand behind an empty comment. <!-- and a real one --> They go on here.",
    "<p>§Between two odd comments<!---> this was lost once.</p><!-- x --!><p>§And this came last.</p>",
    "<html><body><!-- menu --><ul class=menu><li><a href=/>Start</a><li><a href=/n>News</a></ul><!--><div class=text><p>§Snow closed the pass for nine days.</p><p>§® stands on the old signs there.</p></div><div class=footer>Imprint. Terms.</div></body></html>",
    "<body>§Text that stands in the body itself, with no block of its own.<p>§Then a paragraph follows it, of the usual kind.</p></body>",
    "<div><div><section><h2>§Under many roofs</h2><p>§The house had been built onto for two hundred years.</p><p>§&copy; and the year were cut in the beam.</p></section></div></div>",
    "<html><body><nav><a href=/>Home</a> <a href=/b>Books</a></nav><div class='story'><h1>§On copying</h1><p>§Copyright was a word for printers then.</p><p>§It is a word for all of us now.</p></div><div class='sidebar'><p>Read our best of the year</p></div><footer><p>&copy; Books Weekly</p></footer></body></html>",
]


def test_nothing_of_the_article_is_lost():
    model = html_extraction.default_model()
    found = right = wanted = 0
    for page in PAGES:
        want = [x.text.replace("§", "") for x in html_extraction.parse(page) if "§" in x.text]
        got = html_extraction.main_text(page.replace("§", ""), model).split("\n\n")
        found, right, wanted = found + len(got), right + sum(x in want for x in got), wanted + len(want)
    assert right / wanted >= 0.97 and right / found >= 0.97


def test_comments_end_where_they_end():
    texts = lambda page: [x.text for x in html_extraction.parse(page) if x.name == "#text"]
    assert texts("a<!-->b<!-- c -->d<!--->e<!-- > f --!>g") == ["abdeg"]
    assert texts("a<!-- open <p>b") == ["a"]


def test_words_of_attributes_are_learnt():
    page = '<div class="{}"><p>Buy more of it now.</p></div><div class="body"><p>The text is here, and it is long enough.</p></div>'
    labelled = []
    for i in range(40):
        nodes = html_extraction.parse('<div class="zorp"><p>Buy more.</p></div><div class="body"><p>§The text is here.</p></div>' + "<p>§More.</p>" * (i % 2))
        labelled.append((nodes, html_extraction.label(nodes)))
    model = html_extraction.Model(labelled)
    assert "hint=zorp" in model.log and "Buy" not in html_extraction.main_text(page.format("zorp"), model)


def test_a_page_of_megabytes():
    model = html_extraction.default_model()
    page = "<nav><a href=/>Home</a></nav><article>" + "<p>A line of the long text, one of many.</p>" * 60_000 + "</article>"
    assert html_extraction.main_text(page, model).count("\n\n") == 59_999
    assert len(html_extraction.main_text("<p>" + "word " * 800_000 + "</p>", model)) == 5 * 800_000 - 1
