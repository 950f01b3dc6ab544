import pytest

from sitegauge.llm.html_text import blocks, extract_pages, labels, main_text

LONG = "The report that was made for the council is one of the longest that it has seen, and it is on the table of the house with all that it says of the river and of the people who live by it in the valley to the north."
FAIR = "Mill owners along upper reaches asked for higher weirs; the council said no to them last week."
FLAT = "Granite slate basalt marble quartz gneiss limestone sandstone shale chalk pumice obsidian dolomite flint"
SHORT = "A short line."
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(4)) + "</ul>"


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


#: Pages and the blocks that a reader would keep.
CASES = {
    "first pass alone": (f"<div>{p(LONG, LONG)}</div>", [LONG, LONG]),
    "short between good": (f"<div>{p(LONG, SHORT, LONG)}</div>", [LONG, SHORT, LONG]),
    "short at the edge": (f"{LINKS}{p(SHORT, LONG, SHORT)}{LINKS}", [LONG]),
    "heading before good": (f"{LINKS}<h2>On mills</h2>{p(LONG)}<h2>More</h2>{LINKS}", ["On mills", LONG]),
    "near beside good": (f"{LINKS}{p(FAIR, LONG)}", [FAIR, LONG]),
    "near among links": (f"{p(LONG)}{LINKS}{p(FAIR)}{LINKS}", [LONG]),
    "article keeps its short blocks": (f"{LINKS}<article><h1>On mills</h1>{p(LONG, SHORT, FLAT, SHORT)}</article>{LINKS}", ["On mills", LONG, SHORT, FLAT, SHORT]),
    "article of short blocks": (f"{LINKS}<article>{p(SHORT, 'Another.')}</article><footer>{SHORT}</footer>", [SHORT, "Another."]),
    "advert in the article": (f"<article>{p(LONG)}<div class='ad-box'>{p(LONG)}</div>{p(SHORT)}</article>", [LONG, SHORT]),
    "links at the article's end": (f"<article>{p(LONG, SHORT)}<h3>See too</h3>{LINKS}</article>", [LONG, SHORT]),
    "teaser beside the text": (f"<article>{p(SHORT)}</article><div>{p(LONG, LONG, LONG)}</div>", [SHORT, LONG, LONG, LONG]),
    "text outside the article": (f"<article>{p(LONG, LONG)}</article><div>{p(LONG)}</div>", [LONG, LONG]),
    "weak name, good text": (f"<article>{p(LONG)}<div class=legal>{p(LONG, SHORT)}</div></article>", [LONG, LONG]),
    "reader comments": (f"<main>{p(LONG)}<section id=comments>{p(LONG, LONG)}</section></main>", [LONG]),
    "hidden": (f"<main>{p(LONG)}<div style='display: none'>{p(LONG)}</div></main>", [LONG]),
    "nothing but short": (p(SHORT, "Another."), [SHORT, "Another."]),
}


@pytest.mark.parametrize("case", CASES)
def test_hand_labels(case):
    html, want = CASES[case]
    assert main_text(f"<html><body>{html}</body></html>").split("\n\n") == want


def test_density_and_neighbours_settle_the_given_pages(spark):
    """On every given page blocks of the article are settled by the two passes, none by its tag alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    ways = []
    for r in pages:
        found = blocks(r.html)
        ways.append({by for b, (_, by) in zip(found, labels(found)) if b.article})
    assert all(w <= {"density", "neighbours"} for w in ways) and sum("density" in w for w in ways) > len(ways) / 2 and sum("neighbours" in w for w in ways) > len(ways) / 2


def test_query_is_the_function_on_every_page(spark):
    from sitegauge.llm.queries import op10_html_text

    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = op10_html_text(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {k: (main_text(h), len(main_text(h))) for k, h in html.items()}


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>" + "word " * 50_000, "x"), (2, "v", "<a" * 3000, "x"), (3, "w", "</p></div>a &lt; b<p", "x")], "page_id bigint, url string, html string, text string")
    got = extract_pages(rows).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:2] == [0, 0] and max(r.n_chars for r in got) == 249_999
    assert extract_pages(rows.limit(0)).collect() == []
