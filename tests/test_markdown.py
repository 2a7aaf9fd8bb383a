import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions.markdown import markdown, to_markdown

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>Top</h1><p>One <b>two</b>&amp;three.<br>Next", "# Top\n\nOne **two**&three.\nNext"),
        ("<head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><p>kept</p><!-- gone --></body>", "kept"),
        ("<ul><li>a<li>b <a href='/x'>link</a></li></ul><ol><li>one</li><li>two<ul><li>in</li></ul></li></ol>", "- a\n- b [link](/x)\n1. one\n2. two\n  - in"),
        ("<table><tr><th>k<th>v</tr><tr><td>1|2<td>y <i>z</i></table>", "| k | v |\n| --- | --- |\n| 1\\|2 | y *z* |"),
        ("<blockquote><p>said</p><p>again</p></blockquote>after", "> said\n\n> again\n\nafter"),
        ("<pre>  a\n   b</pre><p>&lt;tag&gt; &copy;&nbsp;x</p>", "```\n  a\n   b\n```\n\n<tag> © x"),
        ("<img alt=pic src=p.png><hr>text <a>no href</a>", "![pic](p.png)\n\n---\n\ntext no href"),
        ("<p>open <b>bold", "open **bold**"),
        ("plain", "plain"), ("", ""), (None, None), ("<script>never ended", ""), ("</p></div>stray", "stray"),
    ],
)
def test_pages(html, want):
    assert markdown(html) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href=x>", "</a>", "<pre>", "</pre>", "<h2>", "</h2>", "<br>", "word ", "x", "<", "&amp;"]), max_size=25))
def test_any_nesting_keeps_the_words(parts):
    said = markdown("".join(p for p in parts if p != "<"))
    assert said.count("word") == sum(p == "word " for p in parts)
    assert isinstance(markdown("".join(parts)), str)


def test_all_pages_keep_their_words(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in pages.select("html", to_markdown(F.col("html")).alias("md")).collect():
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r.html)
        words = re.findall(r"\w{4,}", re.sub(r"&\w+;", " ", re.sub(r"<[^>]*>", " ", body)))
        assert [w for w in words if w not in r.md] == [] and not re.search(r"<p>|<div|track\(", r.md)
        assert r.md.count("\n# ") + r.md.startswith("# ") == len(re.findall("<h1", r.html))
