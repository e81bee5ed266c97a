"""Frame operators: skew paths forced by tiny thresholds, compared with brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import arrays, audits, books, chain, keyed, pacing, voices
from inkloom.sources.catalog import ALIASES, VOICES, voice_catalog
from inkloom.sources.pages import pages_scan, site_settings


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_lookup_join_salts_hot_and_null_keys(spark):
    left = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("unused", 4)], "k string, v int")
    for how in ("left", "inner"):
        plain = left.join(right, "k", how).select("id", "k", "v")
        salted = keyed.lookup_join(left, right, "k", spread=["id"], how=how, hot_rows=5, salts=4).select("id", "k", "v")
        assert sorted(salted.collect(), key=str) == sorted(plain.collect(), key=str)


def test_running_sum_over_blocks(spark):
    rng = random.Random(5)
    data = [(k, o, rng.randrange(-5, 9)) for k in ("a", "b", "c") for o in rng.sample(range(1000), 90)]
    frame = spark.createDataFrame(data, "k string, o int, v int")
    got = {(r.k, r.o): r.s for r in keyed.running_sum(frame, ["k"], "o", F.col("v"), "s", block=16).collect()}
    for k, o, _ in data:
        assert got[k, o] == sum(v for kk, oo, v in data if kk == k and oo < o)
    numbers = {(r.k, r.o): r.n for r in keyed.numbered(frame, ["k"], "o", "n", block=16).collect()}
    for k, o, _ in data:
        assert numbers[k, o] == sum(kk == k and oo <= o for kk, oo, _ in data)


def test_small_side_hint_depends_on_size(spark):
    assert keyed.small_side(spark.range(10), 10)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
    assert "ResolvedHint" not in keyed.small_side(spark.range(11), 10)._jdf.queryExecution().analyzed().toString()


def walk(edges, starts, limit):
    out = []
    for start in set(starts):
        at, seq = start, 0
        while at in edges and seq < max(1, limit):
            out.append((start, seq, at))
            at, seq = edges[at], seq + 1
    return sorted(out)


@pytest.mark.parametrize("limit, hot_rows", [(0, 1_000_000), (7, 2), (40, 1_000_000)])
def test_walks_equal_brute_force(spark, limit, hot_rows):
    edges = {f"p{i}": f"p{i + 1}" for i in range(20)}
    edges |= {"p20": None, "loop1": "loop2", "loop2": "loop1", "dangle": "gone", "tail": "p15", "self": "self"}
    starts = ["p0", "p0", "tail", "loop1", "dangle", "missing", "self", "p19"]
    edge_rows = spark.createDataFrame(list(edges.items()), "url string, next_url string")
    start_rows = spark.createDataFrame([(s,) for s in starts], "start_url string")
    got = chain.crawl_many(edge_rows, start_rows, limit, hot_rows=hot_rows, salts=3)
    assert rows(got) == walk(edges, starts, limit)


def test_walk_stops_on_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "url string, next_url string")
    starts = spark.createDataFrame([("a",)], "start_url string")
    got = chain.crawl_many(edges, starts, 9, stop_on_cycle=True)
    assert rows(got) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c")]


def test_edges_and_dangling(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", None), ("c", "gone"), ("d", "gone")], "url string, next_url string")
    assert rows(chain.dangling_next(edges, hot_rows=1, salts=2)) == [("c", "gone"), ("d", "gone")]
    found = {r.url: r.target_found for r in chain.next_edges(edges, hot_rows=1, salts=2).collect()}
    assert found == {"a": True, "b": None, "c": False, "d": False}


def test_books(spark):
    data = [
        ("b", 5, "u5", "T5", "1.02 B", "<p>five</p>"), ("b", 9, "u9", "T<9>", "1.02 B", "<p>nine</p>"),
        ("b", 2, "u2", "T2", "", "<p>two</p>"),
    ]
    chapters = spark.createDataFrame(data, "book_id string, seq int, url string, title string, code string, html string")
    stored = books.chapter_store(chapters)
    assert {(r.slug, r.seq) for r in stored.collect()} == {("1-02-b", 9), ("t2", 2)}
    meta = {r.slug: r.meta for r in books.chapter_meta(stored).collect()}
    assert meta["1-02-b"] == '{"code":"1.02 B","html":"chapters/1-02-b/index.html","title":"T<9>","url":"u9"}'
    text = "".join(r.text for r in books.book_txt(chapters, block=1).orderBy("chapter_no").collect())
    assert text == "T2\n\ntwo\n\nT5\n\nfive\n\nT<9>\n\nnine\n"
    sections = books.book_sections(chapters).orderBy("section_no", "fragment_no").collect()
    toc = "".join(r.body for r in sections if r.section_no == 0)
    assert toc.startswith("<h1>Table of Contents</h1><ol><li><a href=\"ch_001_.xhtml\">T2</a></li>")
    assert toc.endswith('<li><a href="ch_003_1.02-b.xhtml">T&lt;9&gt;</a></li></ol>')
    assert sections[-1].body == "<h2>T&lt;9&gt;</h2><p>nine</p>"
    assert books.book_sections(chapters, toc=False).count() == 3


def test_voices(spark):
    asked = ["en-us", "EN-GB ", "af_heart", "AF_HEART", "xx_new", "fr", "", None, "Bm_George"]
    frame = spark.createDataFrame(list(enumerate(asked)), "i int, want string")
    got = {r.i: (r.voice, r.lang_code) for r in voices.resolve_voice(frame, *voice_catalog(spark), "want").collect()}
    assert [got[i] for i in range(len(asked))] == [
        ("af_heart", "a"), ("bf_emma", "b"), ("af_heart", "a"), ("af_heart", "a"), ("xx_new", "x"),
        ("af_heart", "a"), ("af_heart", "a"), ("af_heart", "a"), ("bm_george", "b"),
    ]
    served = {r.i: (r.voice, r.lang_code) for r in voices.voice_lang(frame, voice_catalog(spark)[1], "want").collect()}
    assert served[1] == ("bf_emma", "b") and served[5] == ("fr", "a") and served[7] == ("af_heart", "a")
    assert voices.voice_names(*voice_catalog(spark)).count() == len(VOICES) + len(ALIASES)


def test_voice_catalog_file(spark, tmp_path):
    path = tmp_path / "voices.json"
    path.write_text('{"voices": [{"id": "af_x", "lang": "a"}],\n "aliases": {"en": "af_x", "us": "af_x"}}')
    found, aliases = voice_catalog(spark, str(path))
    assert rows(aliases) == [("en", "af_x"), ("us", "af_x")]
    assert [tuple(r) for r in found.collect()] == [("af_x", "a", None, None)]


def test_requests_drop_blank_text(spark):
    chunks = spark.createDataFrame([(1, 1, "hi"), (1, 2, " \n")], "doc_id int, part_no int, text string")
    got = voices.synth_requests(chunks, voice=F.lit(""), wanted_format=F.lit("FLAC")).collect()
    assert [tuple(r) for r in got] == [(1, 1, "hi", "af_heart", 24000, "wav", 1.0)]


def test_audits(spark):
    parts = spark.createDataFrame(
        [("a", 1, 24000, 1), ("a", 2, 24000, 1), ("b", 3, 24000, 1), ("b", 4, 22050, 1), ("b", 5, 24000, 2)],
        "base string, part_no int, sample_rate int, channels int",
    )
    assert rows(audits.format_uniform(parts)) == [("a", True, None), ("b", False, 4)]
    paths = spark.createDataFrame([("a", "x.wav"), ("a", "y.WAV"), ("b", "x.wav"), ("b", "d.d/z")], "base string, path string")
    assert rows(audits.ext_set(paths)) == [("a", 1, ".wav", [".wav"], True), ("b", 2, "", ["", ".wav"], False)]


def test_concat_arrays(spark):
    data = [("x", 3, [5.0]), ("x", 1, [1.0, 2.0]), ("x", 2, []), ("y", 9, [7.0])]
    frame = spark.createDataFrame(data, "k string, o int, v array<float>")
    assert rows(arrays.joined_samples(frame, "k", "o", "v", block=1)) == [("x", 0, 1.0), ("x", 1, 2.0), ("x", 2, 5.0), ("y", 0, 7.0)]


@pytest.mark.parametrize("delay, block", [(10, 7), (3, 1000), (0, 50), (1, 1)])
def test_pacing_equals_sequential_limiter(spark, delay, block):
    rng = random.Random(delay + block)
    data = [(i, rng.choice("aab"), rng.randrange(0, 200)) for i in range(120)]
    frame = spark.createDataFrame(data, "id int, host string, at bigint")
    got = {r.id: r.start_us for r in pacing.fetch_pacing(frame, host="host", arrive_us="at", tie="id", delay_us=delay, block=block).collect()}
    ready, step = {}, delay if delay > 0 else pacing.DEFAULT_DELAY_US
    for i, host, at in sorted(data, key=lambda r: (r[2], r[0])):
        start = max(at, ready.get(host, at))
        ready[host] = start + step
        assert got[i] == start


def test_site_settings_and_scan(spark):
    pages = spark.createDataFrame([(1, "https://A.com/x", 200), (2, "https://b.com/y", 503), (3, "https://c.com", None)], "page_id int, url string, status int")
    assert [r.page_id for r in pages_scan(pages).collect()] == [1, 3]
    overrides = spark.createDataFrame([("a.com", 800, None)], "host string, min_text_len int, scene_break_style string")
    got = {r.page_id: (r.host, r.min_text_len, r.scene_break_style, r.br_threshold) for r in site_settings(pages, overrides).collect()}
    assert got[1] == ("a.com", 800, "hr", 3) and got[2] == ("b.com", 50, "hr", 3)


def test_running_sum_over_sparse_orders(spark):
    rng = random.Random(8)
    data = [("hot", rng.getrandbits(62) - (1 << 61), 1) for _ in range(3000)] + [("b", k * 10**15, 2) for k in range(50)]
    frame = spark.createDataFrame(data, "k string, o bigint, v int")
    summed = keyed.running_sum(frame, ["k"], "o", F.col("v"), "s", block=64)
    got = {(r.k, r.o): r.s for r in summed.collect()}
    before = {"hot": 0, "b": 0}
    for k, o, v in sorted(data):
        assert got[k, o] == before[k]
        before[k] += v


def test_repeated_captures_and_loops(spark):
    rows = [("u0", "u1"), ("u1", "u2"), ("u2", None), ("u0", "u1"), ("u1", "u2"), ("u2", None), ("l", "l")]
    edges = spark.createDataFrame(rows, "url string, next_url string")
    starts = spark.createDataFrame([("u0",), ("l",)], "start_url string")
    walked = rows_of(chain.crawl_many(edges, starts, 64, stop_on_cycle=True))
    assert walked == [("l", 0, "l"), ("u0", 0, "u0"), ("u0", 1, "u1"), ("u0", 2, "u2")]
    captures = spark.createDataFrame([(1, "u", "old"), (7, "u", "new"), (3, "v", None)], "page_id bigint, url string, next_href string")
    assert rows_of(chain.latest_captures(captures, "next_href")) == [("u", 7, "new"), ("v", 3, None)]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_edges_are_read_once_when_planned_from_pages(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", None), ("c", "zz")], "url string, next_url string")
    assert rows_of(chain.dangling_next(edges)) == [("c", "zz")]
    plan = chain.next_edges(edges)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan


def block_sizes(cut, *keys):
    return [r["count"] for r in cut.groupBy(*keys, "_block").count().collect()]


def test_blocks_are_of_equal_depth_whatever_the_values(spark):
    rng = random.Random(3)
    # One host has 90 % of arrivals, hours apart, and one arrival lies ten thousand years off.
    data = [("hot", k * 3_600_000_000 + rng.randrange(1000), k) for k in range(7200)]
    data += [(f"h{k % 80}", rng.getrandbits(40), k) for k in range(799)] + [("hot", 10**18, 9999)]
    frame = spark.createDataFrame(data, "host string, at bigint, id int")
    cut = keyed.equal_depth(frame, ["host", "at", "id"], block=200)
    assert cut.count() == 8000 and len(set(r._block for r in cut.select("_block").distinct().collect())) >= 30
    assert max(block_sizes(cut, "host")) <= 400
    found = pacing.fetch_pacing(frame, host="host", arrive_us="at", tie="id", delay_us=5_000_000_000, block=200)
    ready, got = {}, {r.id if r.host == "hot" else (r.host, r.id): r.start_us for r in found.collect()}
    for host, at, i in sorted(data, key=lambda r: (r[1], r[2])):
        start = max(at, ready.get(host, at))
        ready[host] = start + 5_000_000_000
        assert got[i if host == "hot" else (host, i)] == start


def test_running_sum_with_an_outlier_and_null_keys(spark):
    data = [("a", o, 1) for o in range(2000)] + [("a", 10**18, 1)] + [(None, o, 2) for o in range(300)]
    frame = spark.createDataFrame(data, "k string, o bigint, v int")
    assert max(block_sizes(keyed.equal_depth(frame, ["k", "o"], block=100), "k")) <= 200
    summed = keyed.running_sum(frame, ["k"], "o", F.col("v"), "s", block=100)
    assert summed.columns == ["k", "o", "v", "s"]
    got = {(r.k, r.o): r.s for r in summed.collect()}
    assert len(got) == len(data) and got["a", 10**18] == 2000 and got[None, 299] == 598
    assert all(got["a", o] == o and got.get((None, o), 2 * o) == 2 * o for o in range(2000))


@pytest.mark.parametrize("span", [1, 3, 64])
def test_folds_over_earlier_blocks(spark, span):
    rng = random.Random(span)
    data = [(k, b, rng.randrange(-9, 9)) for k in ("a", None) for b in rng.sample(range(40), 20)]
    frame = spark.createDataFrame(data, "k string, _block int, v int")
    for fold, brute in ((F.sum, sum), (F.max, max)):
        got = {(r.k, r._block): r._before for r in keyed.before_blocks(frame, ["k"], "v", fold, span=span).collect()}
        for k, b, _ in data:
            earlier = [v for kk, bb, v in data if kk == k and bb < b]
            assert got[k, b] == (brute(earlier) if earlier else None)


def test_empty_tables_have_no_blocks(spark):
    frame = spark.createDataFrame([], "k string, o bigint, v int")
    assert keyed.running_sum(frame, ["k"], "o", F.col("v"), "s").collect() == []


def random_links(seed: int, n: int) -> dict:
    """Trees, tails, loops that pass through several chains, dead links and single pages."""
    rng = random.Random(seed)
    names = [f"{rng.randrange(10**6):06d}" for _ in range(n)]
    near = lambda k: names[max(0, min(n - 1, k + rng.choice([1, 1, 1, 1, 2, -3, -9])))]
    return {u: rng.choices([near(k), None, "gone"], [12, 1, 1])[0] for k, u in enumerate(names)}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_chains_hold_every_page_once_and_loops_are_chains(spark, seed):
    edges = random_links(seed, 120)
    if seed == 4:  # two chains that enter each other: the loop lies across both
        edges = {"a0": "a1", "a1": "a2", "a2": "b1", "b0": "b1", "b1": "b2", "b2": "a1", "s": "s", "x": "s"}
    frame = spark.createDataFrame(list(edges.items()), "url string, next_url string")
    chains, ends = chain.page_chains(frame, hot_rows=3, salts=2)
    place = {r.url: (r.head, r.rank) for r in chains.collect()}
    end = {r["head"]: r for r in ends.collect()}
    assert sorted(place) == sorted(edges) and chains.count() == len(edges)
    assert {(h, k) for h, r in end.items() for k in range(r.length)} == set(place.values())

    def loop_of(url):
        seen = []
        while url in edges and url not in seen:
            seen.append(url)
            url = edges[url]
        return seen[seen.index(url) :] if url in seen else []

    for url, (head, rank) in place.items():
        row = end[head]
        target = edges[url] if edges[url] in edges else None
        follows = (head, rank + 1) if rank + 1 < row.length else (row.to_head, row.to_rank)
        assert (place[target] if target else (None, None)) == follows
        on_loop = url in loop_of(url)
        assert row.loop == on_loop
        if on_loop:
            assert head == min(loop_of(url)) and row.length == len(loop_of(url))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("stop", [False, True])
def test_walks_of_slices_equal_brute_force(spark, seed, stop):
    edges = random_links(seed, 60)
    frame = spark.createDataFrame(list(edges.items()), "url string, next_url string")
    starts = frame.selectExpr("url as start_url")
    chains, ends = chain.page_chains(frame)
    slices = chain.walk_slices(chains, ends, starts, 45, stop_on_cycle=stop)
    wanted = walk(edges, list(edges), 45)
    if stop:
        wanted = [r for r in wanted if r[2] not in [w[2] for w in wanted if w[0] == r[0] and w[1] < r[1]]]
    assert rows(chain.crawl_many(frame, starts, 45, stop_on_cycle=stop)) == wanted
    assert slices.count() < len(wanted) / 2


def test_next_pages_carry_what_they_show(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "gone"), ("c", None), ("d", "b")], "url string, next_url string")
    pages = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3)], "url string, title string, n int")
    found = chain.next_pages(edges, pages, "title", "n", hot_rows=1, salts=3)
    assert found.columns == ["url", "next_url", "next_title", "next_n"]
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "b", "B", 2), ("b", "gone", None, None), ("c", None, None, None), ("d", "b", "B", 2)]
