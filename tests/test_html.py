"""Text out of HTML: the same as plain patterns give, in time linear in the page's length."""

from __future__ import annotations

import random
import re
import time

import pytest

from lodestone.sources import documents


def by_patterns(html: str) -> str:
    out = re.sub(r"(?s)<!--.*?-->", " ", html)
    for name in documents.DROPPED:
        out = re.sub(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ", out)
    out = re.sub(r"<[^>]*>", " ", out)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = out.replace(entity, char)
    return re.sub(r"\s+", " ", out).strip(" ")


def texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "n int, html string")
    return [r.text for r in df.select("n", documents.html_text(df.html).alias("text")).orderBy("n").collect()]


def test_as_patterns(spark):
    rng = random.Random(2)
    bits = ["<script>", "</script>", "</SCRIPT >", "<Style a='>'>", "</style>", "<nav", ">", "</nav>", "<!--", "-->", "<!-->", "<p>", "<", "a", "b&amp;lt;", " ", "\n", "é", "水", "</script", "<header>", "</header>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(500)]
    assert texts(spark, pages) == [by_patterns(p) for p in pages]
    assert texts(spark, [None, ""]) == ["", ""]


def test_page_text(spark):
    from pyspark.sql import functions as F

    html = F.lit("<p>a&amp;b</p><script>x</script> api_key=abcdefghijklmnop1234567890")
    plain, clean = spark.range(1).select(documents.html_text(html), documents.page_text(html)).first()
    assert plain.startswith("a&b api_key=abc") and clean.startswith("a&b") and "abcdefghijklmnop1234567890" not in clean


@pytest.mark.parametrize("bit", ["<script>", "<script", "<!--", "<", "</script ", "<nav></nav", "<script></script>"])
def test_linear(spark, bit):
    texts(spark, ["x"])
    began = time.time()
    texts(spark, [bit * (1_000_000 // len(bit))])
    assert time.time() - began < 20  # a quadratic search takes minutes
