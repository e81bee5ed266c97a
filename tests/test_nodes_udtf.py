"""Page nodes as a table function for SQL."""

from __future__ import annotations

import inspect

import pyarrow as pa

from inkloom.operators import events
from inkloom.operators.events import page_events, page_nodes, register_page_nodes


def test_lateral_join_equals_page_nodes(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").limit(60)
    odd = spark.createDataFrame([(-1, "u", None), (-2, "v", ""), (-3, "w", "<p>a<b>c<p class=x>d &amp; e")], given.schema)
    pages = given.unionByName(odd).repartition(3, "page_id")
    register_page_nodes(spark)
    pages.createOrReplaceTempView("udtf_pages")
    found = spark.sql("SELECT p.page_id, p.url, n.* FROM udtf_pages p, LATERAL page_nodes(p.html) n")
    wanted = page_nodes(page_events(pages))
    assert found.columns == wanted.columns

    def key(row):
        return row.page_id, row.i

    assert sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)
    counted = spark.sql(
        "SELECT count(*) AS n FROM udtf_pages p, LATERAL page_nodes(p.html) n WHERE n.tag = 'p' AND n.kind = 'open'"
    )
    assert counted.first().n == wanted.filter("tag = 'p' AND kind = 'open'").count()


def test_nodes_of_a_page_are_not_taken_apart_again(monkeypatch):
    html = "<p class=x id=y>a<b>c</b><p>d &amp; e<br>"
    one = events._Events(None)
    events.add_page(one, html)
    # The nodes by way of an Arrow table and back, which took most of the time.
    there = [tuple(node.values()) for node in one.to_arrow().flatten().to_pylist() if node["kind"] != "close"]
    monkeypatch.delattr(events._Events, "to_arrow")
    here = list(events._PageNodes().eval(html))
    assert [(*row[:8], list(row[8].items()), row[9]) for row in here] == there
    assert {"class": "x", "id": "y"} in [row[8] for row in here]


def test_batches_of_events_are_bounded_by_characters():
    pages = ["<p>" + "é word " * 20_000 + f"</p>{k}" for k in range(12)] + [None, ""]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["page_id", "html"])
    # As page_events calls it: few events, but much text.
    most = inspect.signature(page_events).parameters["batch_chars"].default
    found = list(events._batches(None, 200_000, most)([given]))
    assert len(found) == 2 and max(batch.nbytes for batch in found) < 2 * most
    assert [k for batch in found for k in batch["page_id"].to_pylist()] == list(range(len(pages)))
    whole = events._Events(None)
    for page in pages:
        events.add_page(whole, page)
    assert [e for batch in found for e in batch["events"].to_pylist()] == whole.to_arrow().to_pylist()
