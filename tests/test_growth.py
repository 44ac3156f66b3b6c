"""What must not grow with the input: calls per key, arrivals that overlap, texts that are parsed once per mention."""

import datetime as dt
import json
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from mediasift.fixtures import dash as Dx
from mediasift.functions import manifests, text, urls
from mediasift.operators import dash, extractor, hls
from mediasift.operators.pinning import pin
from mediasift.streaming import processors
from mediasift.streaming.running import drain
from workload import ORACLES, QUERIES
from workload.streams import stream_of


class _Held:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class _Handle:
    def __init__(self):
        self.held, self.timers = _Held(), []

    def getValueState(self, name, schema):
        return self.held

    def registerTimer(self, at):
        self.timers.append(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def _jobs(n, seconds, stage, fraction):
    return pd.DataFrame({
        "job_id": [f"j{i}" for i in range(n)], "seq": range(n), "ts": pd.to_datetime([seconds] * n, unit="s"), "state": [None] * n,
        "stage": [stage] * n, "fraction": [fraction] * n,
    })


def test_a_bucket_of_keys_is_one_row_of_state():
    handle, job = _Handle(), processors.Job(ttl_ms=10_000)
    job.init(handle)
    out = pd.concat(list(job.handleInputRows((0,), iter([_jobs(100, 1, "video", 0.1)]), _At(0))))
    assert len(out) == 200 and handle.held.calls == 2 and handle.timers == [11_000]
    out = pd.concat(list(job.handleInputRows((0,), iter([_jobs(50, 5, "video", 0.3)]), _At(0))))
    assert set(out["event"]) == {"milestone"} and set(out["detail"]) == {"video 30%"} and handle.held.calls == 4
    list(job.handleExpiredTimer((0,), _At(11_000), _At(11_000)))
    assert len(json.loads(handle.held.value[1])) == 50 and handle.timers == [11_000, 15_000]
    list(job.handleExpiredTimer((0,), _At(15_000), _At(15_000)))
    assert handle.held.value is None


def test_an_arrival_holds_its_half_only(spark):
    rows = spark.range(0, 1000, 1, 5).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    got = drain(stream_of(spark, rows)).groupBy("batch_no").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 499, 500), (1, 500, 999, 500)]


def test_template_sql_widens_long_numbers(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 7::BIGINT AS l_orderkey, 1::INTEGER AS l_linenumber, 1234567::BIGINT AS l_partkey, 123456::BIGINT AS l_suppkey")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    mine = [tuple(r) for r in QUERIES["expand_templates"](spark, str(tmp_path)).collect()]
    assert mine == con.execute(ORACLES["expand_templates"]).fetchall()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_dump_is_parsed_once(spark):
    dumps = spark.createDataFrame([("https://a.example/w", '{"id":"x","url":"https://a.example/v.mkv","formats":[]}')], "page_url STRING, body STRING")
    found = extractor.extractor_variants(extractor.read_extractor_dumps(dumps))
    assert _plan(found.filter("track = 'muxed'")).lower().count("parse_json(") <= 1
    assert [(r["variant_id"], r["url"], r["ordinal"]) for r in found.collect()] == [("best", "https://a.example/v.mkv", 0)]


def test_attributes_are_not_parsed_by_filters(spark):
    masters = spark.range(2).select(
        F.col("id").cast("string").alias("manifest_id"), F.lit("https://h.example/a/m.m3u8").alias("url"),
        F.concat(F.lit('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",URI="a.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv'), F.col("id").cast("string")).alias("body"),
    )
    for rows, uri in ((hls.hls_renditions(masters), "https://h.example/a/a.m3u8"), (hls.hls_master_variants(masters), "https://h.example/a/v0")):
        filters = [line for line in _plan(rows).split("\n") if line.lstrip(" :+-").startswith("Filter")]
        assert not any("regexp_extract_all" in line or "transform(" in line for line in filters)
        assert uri in [r["uri"] for r in rows.collect()]


def test_addresses_settled_once_are_those_of_each_segment(spark):
    """A template that counts one number up is cut once; odd ones still go segment by segment, with the same addresses."""
    templates = [
        "$Number$.m4s", "$RepresentationID$/$Time$.m4s", "a$$-$Bandwidth$/$number%04d$", "$Number%00d$$$", "x-$Number%3d$.ts", "$Number$-$Time$", "http://h.example:$Number$/a",
        "/r/$Number$", "?n=$Number$", "#$Number$", "../$Number$", ".$Number$", " $Number$ ", "é$Number$", "$SubNumber$", "$Nope$$Number$", "$$Number$", "$Number", "c:$Number$", "//h/$Time%05d$\n",
    ]
    body = "".join(
        f'<Representation id="r {i}" bandwidth="7"><SegmentTemplate startNumber="-1" media="{t}"><SegmentTimeline><S t="98" d="1" r="2"/></SegmentTimeline></SegmentTemplate></Representation>'
        for i, t in enumerate(templates)
    )
    manifest = [("m", "https://h.example/d/x.mpd?q", f"<MPD><Period duration=\"PT9S\"><AdaptationSet>{body}</AdaptationSet></Period></MPD>")]
    reps = dash.dash_representations(dash.parse_manifests(spark.createDataFrame(manifest, "manifest_id STRING, url STRING, body STRING")))
    k = F.col("ordinal")
    each = urls.resolve_url(manifests.expand_template(F.col("template._media"), F.col("rep_id"), F.col("bandwidth"), k - 1, k + 98), "base_url")
    keys = ["manifest_id", "period_no", "set_no", "rep_no"]
    rows = dash.dash_segments(reps).join(reps.select(*keys, "template", "base_url", "bandwidth"), keys).select("rep_no", "ordinal", "uri", each.alias("each")).collect()
    assert len(rows) == 3 * len(templates) and [r for r in rows if r["uri"] != r["each"]] == []
    cut = reps.select(manifests.one_counter(F.col("template._media"), F.col("rep_id"), F.col("bandwidth")).isNotNull().alias("cut")).filter("cut").count()
    assert 5 <= cut < len(templates)


def test_tracks_need_no_layouts_and_folders_join(spark):
    """Without templates and lists everything else is the same; a folder under a folder is joined as it would be resolved."""
    bases = ["a/", "a", "/r/", "../u/", "./v/", "a/../b/", "a//b/", "http://o.example/x", "//o.example/y/", "?q", "é/", "a b/", "c:/d", ".", "a.b/.c/", " t/ ", "%20/"]
    sets = "".join(
        f'<AdaptationSet><BaseURL>{b}</BaseURL><SegmentTemplate media="$Number$"/><Representation bandwidth="{i}"><BaseURL>{c}</BaseURL><SegmentList/></Representation></AdaptationSet>'
        for i, (b, c) in enumerate((b, c) for b in bases for c in bases)
    )
    given = ["https://h.example/p/", "https://H.example:443/p/x.mpd?q=/z/", "https://h.example", "file:///p/"]
    texts = spark.createDataFrame([(u, u, f"<MPD><Period>{sets}</Period></MPD>") for u in given], "manifest_id STRING, url STRING, body STRING")
    whole, tracks = (dash.dash_representations(dash.parse_manifests(texts, layouts)) for layouts in (True, False))
    assert set(whole.columns) - set(tracks.columns) == {"template", "segment_list"}
    rows = tracks.select("manifest_id", "set_no", "base_url", "rep_id", "bandwidth").collect()
    assert sorted(rows) == sorted(whole.select("manifest_id", "set_no", "base_url", "rep_id", "bandwidth").collect())
    assert len(rows) == len(given) * len(bases) ** 2
    pairs = spark.createDataFrame([(u, b, c) for u in given for b in bases for c in bases], "u STRING, b STRING, c STRING")
    resolved = pairs.select("u", "b", "c", urls.resolve_url(F.trim("b"), "u").alias("x")).select("u", "b", "c", urls.resolve_url(F.trim("c"), "x").alias("y"))
    expected = {(r.u, r.b, r.c): r.y for r in resolved.collect()}
    place = [(b, c) for b in bases for c in bases]
    assert [(place[r.set_no], r.base_url) for r in rows if r.base_url != expected[(r.manifest_id, *place[r.set_no])]] == []


def test_pinned_values_are_compiled(spark):
    """A generator with a lambda inside is interpreted node by node; the values of a pin come from a projection."""
    rows = pin(spark.range(3), {"x": F.get(F.transform(F.array("id"), lambda i: i + 1), F.lit(0))}).filter("x > 1")
    generators = [line for line in _plan(rows).split("\n") if "Generate " in line]
    assert len(generators) == 1 and "lambda" not in generators[0] and _plan(rows).count("transform(") == 1
    assert sorted(r["x"] for r in rows.collect()) == [2, 3]


def test_plain_forms_give_what_the_general_ones_give(spark):
    """Plain references, numbers, spans and durations take a short way; a blank in front sends the same text the long way."""
    bases = ["https://h.example/a/b.mpd?q=/x/", "https://h.example", "http://h.example:80/a/", "https://H.example/a/", "https://u@h.example/a/b", "file:///a/b", "https://h.example/a/../b/c", "https://h.example/%20/~x/c#/d/"]
    refs = ["v.ts", "a/b.ts", "a//b", "/r/s.ts", "//o.example/x", "/", "/./x", "/.x", "a/.b", "a/..", ".", "..", "a:b", "a?b=c", "a?b=../c", "a?b=c/./d", "a?b#c", "a#b", "?q", "#f", "k2,v2.key", "a;b@c!$&'()*+=", "%zz", "é", "a b", "a\\b", "a[1]", "x|y", "A.TS?é", "a?b:c", "a\n", "1", "", "\"q\""]
    pairs = spark.createDataFrame([(b, r) for b in bases for r in refs], "b STRING, r STRING")
    parts = urls.base_parts("b")
    got = pairs.select("b", "r", urls.resolve_url("r", "b").alias("x"), urls.resolve_url("r", "b", parts).alias("y"), urls.resolve_url(F.concat(F.lit(" "), "r"), "b").alias("z")).collect()
    assert [g for g in got if not g.x == g.y == g.z] == [] and len({g.x for g in got}) > 100
    numbers = ["7", "007", "999999999", "2147483648", "-1", "+5", "1.5", "9223372036854775808", "", "x", "1e3", ".5", "5.", "NaN", "1d"]
    spans = ["10", "10@20", "@5", "10@", "a@b", "1@2@3", "-1@2", "999999999999999999@1", "9999999999999999999@1", '"7@8"', ""]
    times = ["PT5S", "PT0.5S", "PT1M40.5S", "PT2H", "PT1H2M3S", "PT", "P1D", "-PT5S", "PT5", "PT5.S", "P1Y2M3DT4H5M6.7S", "PT1M2H", "PT0S", "", "P", "PT99999999999S", "pt5s"]
    for function, given in ((text.to_long, numbers), (text.to_int, numbers), (text.to_double, numbers), (manifests.byte_range, spans), (text.iso_seconds, times)):
        rows = spark.createDataFrame([(g,) for g in given] + [(None,)], "t STRING")
        odd = rows.select("t", function(F.col("t")).alias("x"), function(F.concat(F.lit(" "), "t")).alias("y")).collect()
        assert [o for o in odd if o.x != o.y] == []
    blocks = ["#A:1\n#A:2\nx", "#A:1", "x#A:1", "x\n#A:", "#AB:1\n#A:2#A:3", "", None, "#A:1\nx#A:2"]
    rows = spark.createDataFrame([(b,) for b in blocks], "t STRING")
    assert [r[0] for r in rows.select(manifests.last_tag(F.col("t"), "#A")).collect()] == [r[0] for r in rows.select(manifests.last_tag(F.col("t"), "#A", r"[^\n]{0,99}")).collect()]


def test_manifests_are_rendered_in_one_order(spark, tmp_path):
    schema = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    day = dt.datetime(2024, 1, 1)
    lines = [(2, p, 3, n, 1.5, "R", "F", day) for n, p in enumerate((50, 40, 30, 20, 10), 1)] + [(None, 7, 4, 1, 2.0, "A", "O", day), (4, None, 4, 1, 2.0, "A", "O", day)]
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = Dx.manifests(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "lambda" not in plan
    periods = {r.manifest_id: (r.body or "").split("<Period ")[1:] for r in rows.collect()}
    found = [re.findall(r"<BaseURL>(set\d+)/</BaseURL>.*? id=\"r(\d+)\"", p) for p in periods["dash-2"]]
    assert found == [[("set0", "50"), ("set1", "30"), ("set2", "10")], [("set0", "40"), ("set1", "20")]]
    # A key that is null is an order too; an item without a number for its address leaves no set.
    assert len(periods) == 3 and "AdaptationSet" not in "".join(periods["dash-4"])
