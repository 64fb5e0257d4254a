"""Cases that earlier rounds got wrong: clashing columns, popular neighbours, gzip files of many members."""

import gzip
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from socialspark.llm import exact_dedup, registry, source_mix, token_output, url_trust, warc

from test_operators import table, words

CLASHES = ("_sha", "_id", "_source", "_size", "_text", "_nth", "_n", "_copy", "text_sha256", "keep_id", "c0", "mark", "size", "n")


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(c), F.monotonically_increasing_id()) for c in CLASHES})


def test_columns_of_any_name_stay_as_they_are(spark):
    r = random.Random(2)
    rows = [(k, words(r, 30), f"s{k % 3}") for k in range(30)] + [(7, words(r, 30), "s1"), (None, "a b", None), (40, None, "s0")]
    docs = clashing(table(spark, rows))
    given = {r.doc_id: r for r in docs.where("doc_id IS NOT NULL AND doc_id <> 7").collect()}
    for out in (exact_dedup.drop_copies(docs), source_mix.apply_mix(docs)):
        assert out.columns == docs.columns
        assert all(r == given[r.doc_id] for r in out.collect() if r.doc_id in given)
    pages = spark.createDataFrame([(1, "http://x.net/", None), (2, "http://a.org/", None), (None, "http://b.org/", None)], "page_id long, url string, html string")
    pages = clashing(pages).withColumn("host", F.lit("h"))
    assert sorted((r._id, r.host) for r in url_trust.allowed(pages).collect()) == sorted((r._id, "h") for r in pages.where("url NOT LIKE '%net%'").collect())


def link(*to):
    return "".join(f'<a href="https://{x}/p">x</a>' for x in to)


def test_one_bad_link_among_many_and_popular_neighbours(spark):
    pages = [(1, "http://bad.net/", None), (2, "http://news.info/", link(*["popular.org"] * 99, "bad.net")), (3, "http://only.info/", link("bad.net", "bad.net", "popular.org"))]
    pages += [(10 + k, f"http://fan{k}.org/", link("popular.org")) for k in range(60)] + [(90, "http://popular.org/", link("other.org"))]
    got = {r.page_id: (r.verdict, round(r.distrust, 4)) for r in url_trust.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("block", 1.0) and got[2] == ("allow", 0.0085) and got[3] == ("block", round(0.85 * 2 / 3, 4))
    assert {v for v, _ in (got[10 + k] for k in range(60))} == {"allow"} and got[90][0] == "allow"


def test_the_deciding_chances_equal_a_linear_solve(spark):
    r = np.random.default_rng(4)
    n = 25
    trust, distrust = np.where(r.random(n) < 0.2, r.random(n) / 2, 0), np.where(r.random(n) < 0.3, r.random(n) / 2, 0)
    counts = np.where(r.random((n, n)) < 0.15, r.integers(1, 6, (n, n)), 0)
    np.fill_diagonal(counts, 0)
    seeds = spark.createDataFrame([(f"h{k}", float(trust[k]), float(distrust[k])) for k in range(n)], "host string, trust double, distrust double")
    links = spark.createDataFrame([(f"h{i}", f"h{j}", int(counts[i, j])) for i, j in zip(*counts.nonzero(), strict=True)], "src string, dst string, n long")
    got = {x.host: (x.trusted, x.distrusted) for x in url_trust.propagate(seeds, links, tolerance=1e-9).collect()}
    open_ = 0.85 * (1 - trust - distrust)[:, None]
    share = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    bad = np.linalg.solve(np.eye(n) - open_ * share(counts), distrust)
    good = np.linalg.solve(np.eye(n) - open_ * share(counts.T), trust)
    for k in range(n):
        assert got[f"h{k}"] == pytest.approx((good[k], bad[k]), abs=1e-7)


def member(k, size=3000):
    body = b"HTTP/1.1 200 OK\r\n\r\n<p>" + bytes(random.Random(k).randbytes(size)).hex().encode() + b"</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_members_are_read_in_time_in_proportion():
    took = []
    for n in (2000, 4000):
        raw = b"".join(gzip.compress(member(k), 1) for k in range(n))
        began = time.process_time()
        found = list(warc.zipped_records(raw))
        took.append(time.process_time() - began)
        assert len(found) == n and all(ok for _, ok in found)
    assert took[1] < 3 * took[0] + 0.2


@pytest.mark.parametrize("cut", ["by record", "in one", "at odd places", "torn"])
def test_members_anywhere_give_the_same_records(cut):
    junk = b"no record at all\r\n\r\n" + b"x" * 70_000 + b"\r\n\r\n"
    short = member(3).replace(b"Content-Length: ", b"Content-Length: 1")  # states more bytes than it has
    parts = [member(0), member(1, 40_000), junk, member(2), short, member(4), b"WARC/1.1\r\nno length\r\n\r\n", member(5), member(6, 600_000)]
    plain = b"".join(parts)
    pieces = {"by record": parts, "in one": [plain], "at odd places": [plain[k : k + 7777] for k in range(0, len(plain), 7777)], "torn": [plain]}[cut]
    raw = b"".join(gzip.compress(p) for p in pieces)
    if cut == "torn":
        raw = raw[:-300_000]
        got = list(warc.zipped_records(raw))
        assert [r for r, ok in got if ok] == [r for r, ok in warc.split_records(plain) if ok][: sum(ok for _, ok in got)] and not got[-1][1]
    else:
        assert list(warc.zipped_records(raw)) == list(warc.split_records(plain))
    assert list(warc.zipped_records(gzip.compress(b"") * 3)) == []


def test_encoder_holds_no_more_pieces_than_it_may_within_one_text():
    path = registry.tokenizer_path()
    encoder = token_output.PieceEncoder(path, 1_000)
    words = ["w" + "".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(5_000)]
    texts = [" ".join(words), "", "é, ÷. a\t b", "one<|endoftext|>two,\nthree. ", " ".join(words[:300])]
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, n = encoder.encode(np.frombuffer("".join(texts).encode(), np.uint8), offsets, 2)
    assert ids.astype("<u4").tobytes() == b"".join(encoder.whole(t) + b"\2\0\0\0" for t in texts)
    assert n.tolist() == [len(encoder.whole(t)) // 4 + 1 for t in texts]
    assert len(encoder.memo.newer) + len(encoder.memo.older) <= 1_000


def test_encoder_looks_a_piece_of_a_block_up_once(monkeypatch):
    encoder, asked = token_output.PieceEncoder(registry.tokenizer_path(), 1_000), []
    known = encoder.memo.ids
    monkeypatch.setattr(encoder.memo, "ids", lambda pieces: asked.extend(pieces) or known(pieces))
    data = np.frombuffer(b"so it is so it is so it is" * 50, np.uint8)
    encoder.encode(data, np.array([0, len(data) // 2, len(data)]), 2)
    assert len(asked) == len(set(asked)) <= 6


def test_token_digests_are_taken_before_the_join(spark):
    docs = table(spark, [(k, words(random.Random(k), 30) if k % 3 else None, "s") for k in range(40)])
    digests = token_output.digest_table(docs, registry.tokenizer_path(), 2)
    assert digests.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    plan = digests._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")
    rows = token_output.token_digests(token_output.token_table(docs, registry.tokenizer_path(), 2))
    assert sorted(digests.collect()) == sorted(rows.collect())
