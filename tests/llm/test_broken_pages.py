"""Pages of broken tags are read in time linear in their length."""

from __future__ import annotations

import time

import pytest
from sievework.llm import html_extract


@pytest.mark.parametrize("tail", ["", ">", '"', "'>"])
@pytest.mark.parametrize("unit", ['<a "', "<b ", '<a ">"', "<!", "<a x=\">\" '", "</noscript ", "<noscript>", "<script", "<!--", "<p '>\"<b \">'"])
def test_linear(unit, tail):
    def took(n: int) -> float:
        page = unit * (n // len(unit)) + tail
        began = time.process_time()
        html_extract.leaf_blocks(page)
        return time.process_time() - began

    short, long = took(50_000), took(400_000)
    assert long < 2 and long < 40 * max(short, 0.01)


def test_odd_tags():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts('a<b title="x > y">c</b>') == ["ac"]
    assert texts("one <!-- two") == ["one"]
    assert texts('<p>x<a ">">y') == ["x", "y"] or texts('<p>x<a ">">y') == ["xy"]
    assert texts("a < b and c > d") == ["a < b and c > d"]
    assert texts("<p>one</p> <b two <!-- three") == ["one", "<b two"]
    assert texts("x<noscript>y</noscript>z<script>w") == ["xz"]
