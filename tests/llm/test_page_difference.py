"""Pages without an article or main element, where the difference decides."""

from whence.llm import page_text
from whence.llm.queries import prepared


def test_copies_do_not_empty_each_other(spark):
    frame = "<div>Site of all</div>"
    text = [f"<p>{'one two three ' * n}end {n}</p><p>{'four five ' * n}{n} end</p>" for n in range(3, 9)]
    page = lambda n, more="": f"<body>{frame}{text[n]}{more}</body>"
    rows = [
        # Exact copies under one path, and a near copy that has another page on its other side.
        (1, "http://h/a/1", page(0)), (2, "http://h/a/1?print=1", page(0)), (3, "http://h/a/1?print=2", page(0)),
        (4, "http://h/a/2", page(1)), (5, "http://h/a/2?print=1", page(1, "<p>2 May</p>")), (6, "http://h/a/3", page(2)),
        # Nothing but copies on the host.
        (7, "http://k/x", page(3)), (8, "http://k/x?print=1", page(3)), (9, "http://l/x", page(4)), (10, "http://l/y", page(4, "<p>2 May</p>")),
        # The frame of a page without an article is known from one with it.
        (11, "http://m/x", page(5)), (12, "http://m/y", f"{frame}<article>{text[4]}</article>"),
    ]
    pages = prepared(spark).createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in page_text.main_text(pages).collect()}
    own = [t[3:-4].replace("</p><p>", "\n\n") for t in text]
    whole = [f"Site of all\n\n{t}" for t in own]
    assert found == {
        1: own[0], 2: own[0], 3: own[0], 4: own[1], 5: f"{own[1]}\n\n2 May", 6: own[2],
        7: whole[3], 8: whole[3], 9: whole[4], 10: f"{whole[4]}\n\n2 May", 11: own[5], 12: own[4],
    }


def test_pairs_across_partitions(spark):
    rows = [(i, f"http://h/{i % 7}/{i:03}", f"<div>frame</div><p>{'text ' * 9}{i}</p>") for i in range(100)]
    pages = prepared(spark).createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in page_text.main_text(pages).collect()} == {i: f"{'text ' * 9}{i}" for i, _, _ in rows}
