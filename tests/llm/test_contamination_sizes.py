"""Decontamination with many equal or alike items, blocks, and long matches: rows, memory and time stay in proportion."""

import hashlib
import random
import time
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from test_operators import table, words

from socialspark.llm import decontaminate
from socialspark.sources import scratch


def search(items, texts, window=10, parts=1):
    """The operator's task over one batch, without a session."""
    sent = [SimpleNamespace(value=decontaminate.TestSet(items[k::parts], window).windows()) for k in range(parts)]
    if parts > 1:  # the task drops a block by dropping _value
        sent = [SimpleNamespace(**vars(x), _value=0) for x in sent]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["_k0", "text"])
    return [r for out in decontaminate._pass(sent, ["_k0"], ("doc_id",))(iter([batch])) for r in out.to_pylist()]


def brute(items, texts, window=10):
    for text in texts:
        w, hit, found, longest = text.split(), set(), set(), 0
        for name, item in items:
            v = item.split()
            need = min(window, len(v))
            for b in range(len(v) - need + 1 if v else 0):
                for a in range(len(w) - need + 1):
                    if w[a : a + need] == v[b : b + need]:
                        n = need
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        hit.update(range(a, a + need))
                        found.add(name)
                        longest = max(longest, n)
        yield len(w), len(hit), sorted(found), longest


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [1, 3])
def test_equal_items_prompts_and_long_matches(seed, parts):
    r = random.Random(seed)
    vocabulary = (2, 3, 8, 50)[seed % 4]
    items = [(f"i{k}", words(r, r.choice((0, 1, 2, 4, 5, 30, 90)), vocabulary)) for k in range(12)]
    items += [("same", items[5][1]), ("prompt1", words(r, 8, 9) + " x y z"), ("i3", words(r, 25, vocabulary))]
    texts = [words(r, r.choice((0, 1, 3, 40, 120)), vocabulary) for _ in range(15)]
    for name in (6, 8, 9, 12):
        v = items[name][1].split()
        cut = r.randrange(len(v) + 1)
        texts.append(" ".join(["q", *v[cut:], *v, "w1", *v[: cut + 3], "zz"]))
    got = search(items, texts, window=4, parts=parts)
    assert [(g["n_words"], g["n_hit"], g["items"], g["longest"]) for g in got] == list(brute(items, texts, 4))
    for g, (_, n_hit, found, _) in zip(got, brute(items, texts, 4), strict=True):
        assert g["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and g["contaminated"] == (n_hit > 0)
        assert sum(e - b for b, e in zip(g["begins"], g["ends"], strict=True)) == n_hit


def test_match_is_longest_where_another_item_goes_on():
    items = [("a", "x " + " ".join(f"w{k}" for k in range(10)) + " end"), ("b", " ".join(f"w{k}" for k in range(10)) + " y z")]
    assert search(items, ["x " + " ".join(f"w{k}" for k in range(10)) + " y z"])[0]["longest"] == 12


@pytest.mark.parametrize("kind", ["equal", "prompt"])
def test_ten_thousand_items_against_a_repeated_passage(kind):
    r = random.Random(2)
    passage = words(r, 40, 5000)
    items = [(str(k), passage if kind == "equal" else passage + " " + words(r, 20, 5000)) for k in range(10_000)]
    texts = [" ".join([passage] * 100)] * ((4 << 20) // (100 * (len(passage) + 1)))  # 4 MB
    test = decontaminate.TestSet(items, 10).windows()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["_k0", "text"])
    tracemalloc.start()
    began, rows = time.monotonic(), 0
    for out in decontaminate._pass([SimpleNamespace(value=test)], ["_k0"], ("doc_id",))(iter([batch])):
        rows += out.num_rows
        assert set(out.column("n_items").to_pylist()) == {10_000} and set(out.column("n_hit").to_pylist()) == {4000}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 500e6, peak
    assert time.monotonic() - began < 60


def test_a_document_that_is_a_long_item_takes_time_in_proportion():
    took = []
    for n in (40_000, 160_000):
        text = words(random.Random(3), n, 300)
        began = time.monotonic()
        assert search([("1", text), ("2", text + " more")], [text, "z " + text])[1]["longest"] == n
        took.append(time.monotonic() - began)
    assert took[1] < 4 * 2.5 * took[0] + 1


def test_blocks_write_no_text(spark, monkeypatch):
    """A benchmark of many blocks goes over the documents once; nothing is written."""
    monkeypatch.setattr(scratch, "new_path", lambda *a: pytest.fail("writes"))
    r = random.Random(4)
    items = [(k, words(r, 60, 3000)) for k in range(100)]
    texts = [words(r, 50, 3000) + (" " + items[k * 2][1] if k % 3 else "") for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = decontaminate.contamination(docs, bench, block_bytes=5000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = {g.doc_id: g for g in got.collect()}
    for k, (n, n_hit, found, longest) in enumerate(brute([(str(i), x) for i, x in items], texts)):
        assert (rows[k].n_words, rows[k].n_hit, rows[k]["items"], rows[k].longest) == (n, n_hit, found, longest)
