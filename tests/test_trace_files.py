"""Trace files: the parser of small files, and files that grow in number with the log."""

import gzip

import pytest

from caselog.operators import loading
from caselog.sources import retail, xes
from checks import fixtures

ODD = (
    '<?xml version="1.0"?><!DOCTYPE log><x:log xmlns:x="http://www.xes-standard.org/"><x:string key="concept:name" value="log"/>'
    '<x:trace><float key="n" value="1"/><event><date key="time:timestamp" value="2016"/><string key="EventID" value="a&amp;&lt;b&quot;">'
    '<string key="inner" value="1"/></string><list key="l"><string key="in" value="2"/></list></event>'
    "<string value='late \n&#10;line' key='concept:name'/><int key='empty'/><string value='no key'/><!-- </trace> --></x:trace>"
    '<trace/><trace><event/><string key="concept:name" value="é"/><event><id key="i" value=""/></event></trace></x:log>'
)


def rows(traces):
    return sorted(traces.drop("trace_pos").collect(), key=str)


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_both_readers_give_the_same_traces(spark, tmp_path, monkeypatch, chunk):
    data = ODD.encode()
    (tmp_path / "log.xes").write_bytes(data)
    with open(tmp_path / "log.xes.gz", "wb") as f:  # two gzip members
        f.write(gzip.compress(data[:300]) + gzip.compress(data[300:]))
    small = xes.read_traces(spark, str(tmp_path / "log.xes*"))
    parsed = [b for name in ("log.xes", "log.xes.gz") for b in xes._parsed(
        name, (data[i:i + chunk] for i in range(0, len(data), chunk)))]
    assert sum(b.num_rows for b in parsed) == 6
    monkeypatch.setattr(xes, "SMALL_FILE", 0)
    large = xes.read_traces(spark, str(tmp_path / "log.xes*"))
    assert rows(small) == rows(large) and small.schema == large.schema
    assert "Scan xml" not in small._jdf.queryExecution().toString()
    flat = xes.flatten_events(small.where("source_file like '%log.xes'"), "first").orderBy("trace_pos", "event_pos").collect()
    assert [(r.document_id, r.event_id, r.raw_time) for r in flat][0] == ("late  \nline", 'a&<b"', "2016") and len(flat) == 3


@pytest.mark.parametrize("data", [
    gzip.compress(ODD.encode())[:-30], gzip.compress(ODD.encode()[:-10]), gzip.compress(b"<log><trace></log>"), b"no gzip"])
def test_files_that_end_early_fail(spark, tmp_path, data):
    (tmp_path / "log.xes.gz").write_bytes(data)
    with pytest.raises(Exception, match="malformed file"):
        xes.read_traces(spark, str(tmp_path / "log.xes.gz")).collect()


def test_files_grow_with_the_log(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "FILE_CASES", 100)
    traces = fixtures.order_traces(spark, sf)
    assert traces.select("source_file").distinct().count() == 15
    cases = retail.order_cases(spark, sf)
    assert traces.count() == cases.count()
    signs = cases.limit(3).selectExpr("'a<\"&\n' || application_id as application_id", "* except (application_id)")
    path = f"{fixtures.session.scratch_path(spark, 'xes')}"
    fixtures.write_traces(signs, retail.order_events(spark, sf), path)
    got = loading.load_cases(xes.read_traces(spark, path))
    assert {r[0] for r in got.select("application_id").collect()} == {r[0].strip() for r in signs.select("application_id").collect()}
