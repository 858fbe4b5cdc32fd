"""A URL hides nothing but its own host and path, and keys of letters alone are found."""

from blockyard.llm import queries, secret_scan
from blockyard.llm.bpe import PATTERN

KEY, LETTERS = "q9A8f7Kq2Lp0ZtY3wVbN4mR6s", "qXvKjZwRbTqYpLmNcHgDxSfW"


def found(text):
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding = secret_scan._encoding(f.read(), PATTERN)
    return [text[a:b] for k, a, b in secret_scan.scan(text, encoding, 2.2) if k == "random"]


def test_urls_end():
    for text in (f'{{"u":"https://a.b/c","k":"{KEY}"}}', f"https://a.b/c,{KEY}", f"https://a.b/c\t{KEY}", f"[x](https://a.b/c){KEY}"):
        assert found(text) == [KEY]
    assert found(f"https://a.b/c?sig={KEY}&x=1") == [KEY]
    assert found(f"https://me:{KEY}@a.b/c") == [KEY]
    assert found(f"https://a.b/{KEY} https://a.b/@x/{KEY}#top") == []


def test_letters_alone():
    assert found(f"k {LETTERS} k") == [LETTERS]
    assert found("Donaudampfschifffahrtsgesellschaft internationalization/localization 47853805923911390000") == []
