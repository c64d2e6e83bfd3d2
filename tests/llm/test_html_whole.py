"""Pages of which op2 once returned a part."""

import pytest

from leafwire.llm import html_text

LONG = "Long text of the article goes on and on. " * 20


@pytest.mark.parametrize(
    "page,lines",
    [
        (f"<main><h1>Title</h1><p>The lead of it.</p><article><p>{LONG}</p></article></main>", ["Title", "The lead of it.", LONG.strip()]),
        (f"<body><article><p>{LONG}</p></article><article><p>Second. {LONG}</p></article></body>", [LONG.strip(), f"Second. {LONG}".strip()]),
        (f"<body><div><h1>Head</h1><p>The lead of it.</p><div><p>{LONG}</p></div><p>The tail.</p></div></body>", ["Head", "The lead of it.", LONG.strip(), "The tail."]),
        (f"<body><div><p>{LONG}</p><p><a href=x>Mostly a link</a> here</p></div></body>", [LONG.strip(), "Mostly a link here"]),
        (f"<body><div><a href=x>One</a> <a href=y>Two</a></div><div><p>{LONG}</p></div></body>", [LONG.strip()]),
        ("<article>" + "<b>" * 1200 + f"<p>{LONG}</p><nav>menu <div>more menu</div></nav><p>End.</p></article>", [LONG.strip(), "End."]),
    ],
)
def test_nothing_but_furniture_is_dropped(page, lines):
    assert html_text.main_text(page).split("\n") == lines
