"""Extraction: role words, wrappers that decide, and grown references."""

import random

from scribegauge.llm import html_extract


def test_role_words_are_whole_and_spare_the_main_text():
    main_text = html_extract.main_text
    assert main_text("<body class='page has-sidebar'><div class='content with-sidebar'>text</div>") == "text"
    assert main_text("<body class='sidebar'><article class='post tags social'>text</article>") == "text"
    assert main_text("<div class='content sidebar'><article>text</article></div>") == "text"
    assert main_text("<div data-id='ad' data-role='menu' title=\"x class='ad'\">text</div><div class='ad'>buy</div>") == "text"
    assert main_text("<article>text<div class='social'>share</div></article>") == "text"


PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, f"http://a.net/{i}", html) for i, html in enumerate(pages)]
    got = html_extract.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_slots_decide_on_pages_with_an_article(spark):
    card = "<article><h2>Card {0}</h2></article>"
    pages = [f"<body>{card.format(i % 2)}<div>Real text {i}</div><article><p>Read our terms</p></article></body>" for i in range(5)]
    assert texts(spark, pages) == [f"Card {i % 2}\n\nReal text {i}" for i in range(5)]
    # Copies of one page do not make its text template.
    assert texts(spark, ["<body><article><p>One story</p></article></body>"] * 4) == ["One story"] * 4


def test_reference_grows_from_all_pages(spark):
    notice = "<section><em>Notice to all</em></section>"
    pages = [None, ""] + [f"<body>{notice if i % 2 else ''}<p>Text {i}</p></body>" for i in range(8)]
    assert texts(spark, pages) == ["", ""] + [f"Text {i}" for i in range(8)]
    # Siblings of one label are slots of their own.
    assert texts(spark, [f"<body><p>Welcome</p><p>Text {i}</p></body>" for i in range(4)]) == [f"Text {i}" for i in range(4)]


def test_merged_tree_holds_both():
    shapes = [html_extract.parse(h).shape() for h in ("<div><h1>a</h1><p>b</p></div>", "<div><p>x</p><em>y</em><p>z</p></div><ul><li>q</ul>")]
    merged = html_extract.merge_trees(*shapes)
    for shape in shapes:
        assert -1 not in html_extract.simple_tree_matching(shape, merged)


def test_blocks_stay_whole():
    main_text = html_extract.main_text
    assert main_text("<p>foo <button>x</button> bar</p>") == "foo bar"
    assert main_text("<p>foo <span class='ad'>buy</span> bar</p><div class='ad'>x <b>y</b></div>z") == "foo bar\n\nz"
    assert main_text("<header>site</header><article><header><h1>Title</h1><p>by me</p></header><p>text</p></article>") == "Title\n\ntext"
    assert main_text("<div>" * 500 + "deep" + "</div>" * 500) == "deep"


def test_a_block_has_its_own_slot(spark):
    assert texts(spark, [f"<body><p><b>Note:</b> text {i}</p></body>" for i in range(4)]) == [f"Note: text {i}" for i in range(4)]


def largest_match(one, two):
    """Size of the largest order-preserving match of two trees ``(label, children)``, told plainly."""
    if one[0] != two[0]:
        return 0
    best = [[0] * (len(two[1]) + 1) for _ in range(len(one[1]) + 1)]
    for i, x in enumerate(one[1], 1):
        for j, y in enumerate(two[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest_match(x, y))
    return best[-1][-1] + 1


def test_tree_matching_against_brute_force():
    rng = random.Random(8)

    def tree(depth):
        return rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []

    def shape(root):
        lines = []

        def write(node, parent):
            lines.append(f"{parent} {node[0]}")
            at = len(lines) - 1
            for child in node[1]:
                write(child, at)

        write(root, -1)
        return "\n".join(lines)

    for _ in range(300):
        one, two = ("#root", tree(3)[1]), ("#root", tree(3)[1])
        mapped = html_extract.simple_tree_matching(shape(one), shape(two))
        used = [m for m in mapped if m >= 0]
        assert len(used) == len(set(used)) == largest_match(one, two) and used == sorted(used)
