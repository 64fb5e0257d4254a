"""Whole jobs of the corpus operators: rows with null or repeated ids, every character reference."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from socialspark.llm import source_mix, warc


def test_mixing_keeps_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 4 * 4, f"w{i} " * (5 + i % 40), "en", ("a", "b", None)[i % 7 % 3], i) for i in range(600)]
    rows += [(9000, "same words here", "en", "a", 1)] * 5 + [(None, "the same null", "en", "b", 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixture(spark, docs, "").select("doc_id", "text", "source").collect()
    got = Counter((r.doc_id, r.text, r.source) for r in out)
    assert any(i is None for i, _, _ in got)
    taken = source_mix.mix(docs).agg(F.sum("taken")).first()[0]
    assert abs(sum(len(t.split()) * n for (_, t, _), n in got.items()) - taken) < 0.03 * taken
    shares = source_mix.mix(docs, keep={"text": F.col("text")}).collect()
    want = Counter()
    for r in shares:
        want[r.doc_id, r.text, r.source] += int(r.taken / r.size + 0.5)
    assert got == +want


def test_every_character_reference_is_decoded(spark):
    html = "<title>Caf&eacute; &#8211; &#x2019;s</title><p>a&mdash;b&hellip; &amp;lt; &lt;i&gt; &nbsp;&#160;x &#X41; &notareference; &apos;&quot;&#39; &amp;#8217; 1 & 2</p>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", "<p>none</p>"), (3, None, None)], "page_id long, url string, html string")
    d = {(r.page_id, r.record_type): r for r in warc.derivatives(warc.response_records(pages)).collect()}
    want = "Caf\u00e9 \u2013 \u2019s\na\u2014b\u2026 &lt; <i> x A \u00acareference; '\"' &#8217; 1 & 2"
    assert d[1, "conversion"].content == want and d[1, "conversion"].content_length == len(want.encode())
    assert "title: Caf\u00e9 \u2013 \u2019s\r\n" in d[1, "metadata"].content
    assert d[2, "conversion"].content == "none" and d[3, "conversion"].content == ""
