"""Settings by site in one pass over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.config import DEFAULT, SitePresets
from inkloom.operators import extract
from inkloom.plans.pipelines import site_chapters

BODY = (
    '<html><head><meta property="og:title" content="Titel"></head><body><div class="story"><p>Story text of {h}.</p>'
    "<p>~~~</p><p>***</p><p>one<br><br>two<br><br><br>three</p><ul><li>outer <p>inner</p></li></ul>"
    '<p><a href="/n">Weiter</a></p><p><a href="/p"> Zurück </a></p></div>'
    "<article><h1>Chapter 1.2 of {h}</h1><p>Article text of {h}.</p><hr><p>More.</p>"
    '<a href="/next">Next</a></article></body></html>'
)
PRESETS = {
    "plain": DEFAULT.but(min_text_len=1),
    "story": DEFAULT.but(min_text_len=1, selectors=(".story",)),
    "texts": DEFAULT.but(min_text_len=1, selectors=(".story",), next_texts=("Weiter",), prev_texts=("Zurück",)),
    "trim": DEFAULT.but(min_text_len=1, selectors=(".story",), next_texts=("Weiter",), prev_texts=("Zurück",), trim_nav_labels=True),
    "breaks": DEFAULT.but(min_text_len=1, selectors=(".story",), scene_break_patterns=(r"^~+$",), scene_break_style="spacer"),
    "lines": DEFAULT.but(min_text_len=1, selectors=(".story",), br_threshold=2, scene_break_style="none"),
    "nested": DEFAULT.but(min_text_len=1, selectors=(".story",), dedupe_nested=True),
    "long": DEFAULT.but(min_text_len=10_000),
    **{f"len{k}": DEFAULT.but(min_text_len=10 * k) for k in range(12)},
}
HOSTS = [*PRESETS, "unknown", "none"]


def tables(spark):
    pages = [(k, f"https://{h.upper()}.example/x", BODY.format(h=h)) for k, h in enumerate(HOSTS)]
    sites = [(f"{h}.example", h) for h in HOSTS if h != "none"] + [("other.example", None)]
    return (
        spark.createDataFrame(pages, "page_id bigint, url string, html string"),
        spark.createDataFrame(sites, "host string, preset string"),
    )


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_one_pass_equals_a_pass_for_each_preset(spark):
    pages, sites = tables(spark)
    found = site_chapters(pages, sites, PRESETS)
    wanted = []
    for k, host in enumerate(HOSTS):
        own = pages.filter(F.col("page_id") == k)
        wanted += rows(extract.chapters(own, PRESETS.get(host, DEFAULT)))
    assert found.columns == ["page_id", "url", "title", "code", "html", "next_href"]
    assert rows(found) == sorted(wanted)
    assert len({r[4] for r in wanted}) >= 6 and len({r[5] for r in wanted}) >= 2


def test_pages_are_read_and_parsed_once_whatever_the_presets(spark, tmp_path):
    pages, sites = tables(spark)
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    plan = site_chapters(stored, sites, PRESETS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_settings_that_do_not_differ_add_no_choice():
    settings = SitePresets({"a": DEFAULT.but(min_text_len=7), "b": DEFAULT.but(min_text_len=7)})
    made = []
    settings.choose(("selectors",), lambda own: made.append(own) or F.lit(1))
    assert made == [DEFAULT]
    settings.choose(("min_text_len",), lambda own: made.append(own.min_text_len) or F.lit(1))
    assert made[1:] == [7, 50]


def test_pages_of_an_error_status_are_told_without_being_parsed(spark):
    schema = "page_id bigint, url string, html string, status int"
    pages = spark.createDataFrame([(1, "u", BODY, 503), (2, "v", BODY, 200), (3, "w", BODY, None)], schema)
    config = PRESETS["plain"]
    assert rows(extract.rejects(pages, config)) == [(1, "u", "http status 503")]
    judged = {r.page_id: r for r in extract.judged_pages(pages, config).collect()}
    assert judged[1].html == "" and judged[1].next_href is None and judged[2].html == judged[3].html != ""
