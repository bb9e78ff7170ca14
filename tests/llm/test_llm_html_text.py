"""Pages whose wrappers speak of sidebars, and elements that are never closed."""

import pytest

from gistmill.llm import html_text

LONG = "The river rose through the night and by morning the lower fields stood under water."


@pytest.mark.parametrize("page, text", [
    (f"<div class='content has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='content-sidebar-wrap'><main><p>{LONG}</p></main></div>", LONG),
    (f"<div class='page no-sidebar'><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<form><div><main><p>{LONG}</p></main></div></form>", LONG),
    (f"<article><header class='entry-header'><h1>Its title</h1></header><p>{LONG}</p></article>", f"Its title\n\n{LONG}"),
    *[(f"<article><p>{LONG}</p><{tag}>x<p>{LONG}</p></article>", f"{LONG}\n\n{LONG}") for tag in ("button", "select", "object", "video", "canvas")],
    (f"<article><button>x<p>{LONG}</p><button>y</button></article>", LONG),
    # what stands apart by its own name or element stays out
    (f"<article><p>{LONG}</p></article><section class=comments><article><p>{LONG}</p></article></section>", LONG),
    (f"<div hidden><main><p>{LONG}</p></main></div><main><p>kept words stay</p></main>", "kept words stay"),
    (f"<article><p>{LONG}</p><script>never closed <p>{LONG}</p></article>", LONG),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text
