"""Whole articles: dominant sections and names that merely contain a bad word drop nothing."""

import pytest

from tripmart.llm.html_extraction import bad_name, main_text

BODY = "".join(f"<p>Sentence {i}, which is long enough, fills the body of this text.</p>" for i in range(12))
PARTS = f"<h1>Head</h1><p>The lead, a short one.</p><div>{BODY}</div><section><p>The last part, at the end.</p></section>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_dominant_section(tag):
    text = main_text(f"<html><body><nav>Menu</nav><div><{tag}>{PARTS}</{tag}></div><footer>End</footer></body></html>")
    assert text.startswith("Head The lead, a short one. Sentence 0") and text.endswith("The last part, at the end.")


def test_dominant_section_without_article():
    last = "<p>Another sentence, about as long as the others, ends this text.</p>"
    text = main_text(f"<html><body><div><div>{BODY}</div><section>{last}</section></div></body></html>")
    assert text.startswith("Sentence 0") and text.endswith("ends this text.")


def test_names_that_contain_a_bad_word():
    page = f"<html><body><div class='content with-sidebar'>{BODY}<section id='related-work'><p>Others did this, too.</p></section></div></body></html>"
    assert main_text(page).startswith("Sentence 0") and main_text(page).endswith("Others did this, too.")
    assert [bad_name(n) for n in ("sidebar", "primary-sidebar", "share-buttons", "ad-slot-1", "comments_area", "site-footer")] == [True] * 6
    assert [bad_name(n) for n in ("with-sidebar", "no-ads", "related-work", "share-enabled", "content", "", "-")] == [False] * 7
