"""Main text beside an article stays."""

from zonalis.llm import html_text


def test_main_text_beside_an_article_stays():
    page = html_text.Page("<main><h1>Head</h1><p>Lead</p><article><p>Story</p></article></main><p>Outside</p>")
    assert page.text() == "Head\n\nLead\n\nStory"
    page = html_text.Page("<div id=content><p>The whole story.</p></div><article><p>Card</p></article><p>Outside</p>")
    assert page.text() == "The whole story.\n\nCard"
