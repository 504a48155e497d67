"""HTML: heads without an end tag, and vectors of long blocks."""

import numpy as np

from marlstone.llm import html_blocks


def test_head_without_end_tag():
    for page in ("<head><title>x</title><body><article><p>One", "<html><head><meta charset=utf-8><title>x</title><style>p{}</style><article><p>One</article>", "<head><title>x</title></head><body><article><p>One", "<HEAD lang=en><link href=y><bgsound src=z><article><p>One"):
        found = html_blocks.blocks_of(page)
        assert [b.text for b in found] == ["One"] and not any("head" in p or "bgsound" in p for p in found[0].path)
        assert found[0].path[-2:] == ("article", "p")


def test_every_word_of_a_long_block_counts():
    words = [f"w{k}" for k in range(400)]
    block = lambda ws: html_blocks.Block(("p",), " ".join(ws), 0)
    whole = html_blocks.Features().page([block(words)])[0]
    for k in range(0, 400, 7):
        other = [*words[:k], "changed" + words[k][1:], *words[k + 1 :]]
        mine = html_blocks.Features().page([block(other)])[0]
        part = slice(html_blocks.PATH_DIMS, html_blocks.PATH_DIMS + html_blocks.WORD_DIMS)
        same = html_blocks.zlib.crc32(words[k].encode()) % html_blocks.WORD_DIMS == html_blocks.zlib.crc32(other[k].encode()) % html_blocks.WORD_DIMS
        assert same or not np.array_equal(whole[part], mine[part])
