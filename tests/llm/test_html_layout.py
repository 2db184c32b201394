import random
import time

import pytest

pytest.importorskip("pyarrow")
from kinweave.llm.html_text import extract_html, visible_text


class Plain:
    """Brute force: a page built as a tree, and its text rendered from that tree alone, each piece by its own rule."""

    def __init__(self, rng):
        self.rng, self.n = rng, 0

    def words(self):
        self.n += 1
        return [f"w{self.n}", *(self.rng.choice(["a", "bb", "&amp;", "ccc"]) for _ in range(self.rng.randrange(4)))]

    def inline(self):
        own, tag = self.words(), self.rng.choice(["", "b", "span", "a"])
        text = " ".join(own).replace("&amp;", "&")
        hidden = tag and self.rng.random() < 0.2
        source = "\n  ".join(own)
        if tag:
            style = self.rng.choice([" hidden", " style='display:none'", " style=visibility:hidden"]) if hidden else ""
            source = f"<{tag}{style}>{source}</{tag}>"
        return source, "" if hidden else text

    def run(self):
        parts = [self.inline() for _ in range(self.rng.randrange(1, 4))]
        return " ".join(s for s, _ in parts), " ".join(t for _, t in parts if t)

    def items(self, depth):
        """A list's source without all end tags, and its lines."""
        source, lines = "", []
        ordered, number = self.rng.random() < 0.5, 0
        for _ in range(self.rng.randrange(1, 4)):
            s, t = self.run()
            own = [t] if t else []
            source += f"<li>{s}"
            if depth < 3 and self.rng.random() < 0.4:
                more, below = self.items(depth + 1)
                source, own = source + more, own + below
            source += self.rng.choice(["", "</li>"])
            number += 1
            marker = f"{number}. " if ordered else "- "
            lines += [(marker if k == 0 else " " * len(marker)) + x for k, x in enumerate(own)]
        return (f"<ol>{source}</ol>" if ordered else f"<ul>{source}</ul>"), lines

    def table(self):
        """Cells of one column each, but for those that take two rows."""
        wide, rows = self.rng.randrange(1, 4), self.rng.randrange(1, 4)
        grid = [[None] * wide for _ in range(rows)]
        source = ""
        for r in range(rows):
            source += "<tr>"
            for c in range(wide):
                if grid[r][c] is None:
                    s, t = self.run()
                    down = r + 1 < rows and self.rng.random() < 0.2
                    source += f"<td rowspan=2>{s}" if down else f"<td>{s}" + self.rng.choice(["", "</td>"])
                    grid[r][c] = t
                    if down:
                        grid[r + 1][c] = ""
        size = [max(len(row[c]) for row in grid) for c in range(wide)]
        lines = [" | ".join(t.ljust(n) for t, n in zip(row, size)).rstrip(" |") for row in grid]
        return f"<table>{source}</table>", [x for x, row in zip(lines, grid) if any(row)]

    def page(self):
        source, blocks = "", []
        for _ in range(self.rng.randrange(1, 6)):
            kind = self.rng.choice(["p", "h2", "list", "table", "script"])
            if kind == "script":
                source += "<script>var x = '<p>no</p>';</script><style>p {}</style><!-- <p>no -->"
                continue
            if kind in ("p", "h2"):
                s, t = self.run()
                source += f"<{kind}>{s}" + ("</h2>" if kind == "h2" else self.rng.choice(["", "</p>"]))
                lines = [t] if t else []
            else:
                s, lines = self.items(0) if kind == "list" else self.table()
                source += s
            if lines:
                blocks.append("\n".join(lines))
        return f"<html><head><title>no</title></head><body>{source}", "\n\n".join(blocks)


def test_generated_pages_against_brute_force(spark):
    plain = Plain(random.Random(8))
    pages = [plain.page() for _ in range(1500)]
    got = extract_html(spark.createDataFrame([(k, "u", s) for k, (s, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == 1500
    for r in got:
        assert r.text == pages[r.page_id][1], pages[r.page_id][0]


def test_tables():
    assert visible_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a | b\n  | c\nd | e"
    long = "y" * 80
    assert visible_text(f"<table><tr><td>{long}<td>z<tr><td>c<td>d</table>") == f"{long} | z\n{'c'.ljust(80)} | d"
    assert visible_text("<table><tr><td colspan=200>all<tr><td>c<td>d</table>") == "all\nc | d"
    assert visible_text("<table><tr><td colspan=2>wide cell<td>b<tr><td>c<td>d<td>e</table>") == "wide cell | b\nc | d     | e"
    assert visible_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


def test_what_is_visible_again():
    assert visible_text("<div style='visibility:hidden'>no<p style='visibility: visible'>yes <b>too</b></div>after") == "yes too\n\nafter"
    assert visible_text("<div style='display:none'>no<p style='visibility:visible'>no</div>after") == "after"


@pytest.mark.parametrize(
    "page", ["<p><object>" + "<span>" * 16000 + "<div>" * 16000, "<ul><li>a" * 16000, "<b><i>" * 10000 + "</b>" * 10000 + "</i>" * 10000, "<table><tr><td>" + "x" * 500_000 + "<td>b" + "<tr><td>c<td>d" * 20000, "<table>" + "<tr><td colspan=1000>a<td>b" * 20000, "<table><tr>" + "<td rowspan=9999>a" * 5000 + "<tr><td>c" * 5000]
)
def test_time_and_memory_of_hostile_pages(page):
    began = time.time()
    assert len(visible_text(page)) < 20_000_000 and time.time() - began < 20


def test_odd_pages(spark):
    schema = "page_id string, url string, html string, text long, n_lines string"
    rows = [("a", "u", None, 1, "x"), ("a", "u", None, 1, "x"), (None, None, "<p>x", 2, None), ("b", "u", "<p>" + "long " * 300_000, 3, "x")]
    got = sorted(((r.page_id, r.n_lines, r.n_chars) for r in extract_html(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([("a", 0, 0), ("a", 0, 0), (None, 1, 1), ("b", 1, 1_499_999)], key=str)
    assert extract_html(spark.createDataFrame([], schema)).count() == 0
