import pytest

pytest.importorskip("pyarrow")
from kinweave.llm.html_text import visible_text


def test_formulas_and_labels_are_visible():
    assert visible_text("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then") == "if x=2 then"
    assert visible_text("<p>a</p><svg><g><text x=1>North</text><text x=2>So<tspan>uth</tspan></text></g></svg><p>b") == "a\n\nNorth South\n\nb"
    assert visible_text("<svg><foreignObject><div>in</div></foreignObject></svg>out") == "in\nout"


@pytest.mark.parametrize("name", ["defs", "metadata", "desc", "title", "symbol", "clipPath", "mask", "pattern", "marker"])
def test_unseen_parts_of_svg(name):
    assert visible_text(f"<svg><{name}><g>no</g></{name}><text>yes</text></svg> z") == "yes z"
    assert visible_text(f"<svg><{name}/><path d='M0'/><text>yes</text></svg> z") == "yes z"
    assert visible_text(f"<svg><text>yes</text><{name}></{name}></svg> z") == "yes z"


@pytest.mark.parametrize("name", ["annotation", "annotation-xml"])
def test_unseen_parts_of_math(name):
    assert visible_text(f"<math><semantics><mi>x</mi><{name} encoding='t'>\\x</{name}></semantics></math> z") == "x z"


def test_what_ends_with_svg():
    assert visible_text("<svg><defs><g>no</svg>yes") == "yes" and visible_text("<svg/>yes<desc>too</desc>") == "yestoo"
    assert visible_text("<svg><text display='none'>no</text><text visibility=hidden>no</text></svg>yes") == "yes"
