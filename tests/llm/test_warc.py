from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from quaymark.llm import warc as w

SCHEMA = "page_id long, url string, html string, digest string, size long, first long, n int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2, 3) for i, u, h in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "http://a/", "é<p>"), (2, "http://b/\r\nX: y", "é<p>"), (7, None, None), (8, "", ""), (9, "http://c/", "z" * 300_000), (3, "u", "é<p>")]
    found = {r["page_id"]: r for r in w.round_trip(pages(spark, rows)).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        own = first[h or ""]
        assert found[i]["payload_bytes"] == len((h or "").encode()) and found[i]["payload_digest"] == digest(h)
        assert found[i]["record_type"] == ("response" if own == i else "revisit")
        assert found[i]["refers_to"] == (None if own == i else own)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "b"), (None, "u", "b"), (1, "u", "b")]
    found = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in w.round_trip(pages(spark, rows)).collect())
    assert found == [("1", "response", "None")] * 2 + [("None", "response", "None")] * 2 + [("None", "revisit", "1")]
    assert w.round_trip(pages(spark, [])).count() == 0


def archive(*members):
    return io.BytesIO(b"".join(members))


def test_each_record_is_a_gzip_member_and_text_comes_back():
    one, two = w.record(1, "http://a/", b"x" * 100_000, None, False), w.record(2, "http://b/", b"x" * 100_000, 1, True)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n") and len(gzip.decompress(two)) < 2000
    got = list(w.read_records(archive(one, two)))
    assert [f["warc-type"] for f, _ in got] == ["response", "revisit"]
    assert got[0][1].endswith(b"x" * 100_000)
    parsed = w._parsed("p", 1, *got[1])
    assert parsed[6] == 100_000 and parsed[8] == 1


@pytest.mark.parametrize("harm", ["cut", "payload", "length", "joined"])
def test_damage_is_found(harm):
    member = w.record(1, "u", b"payload", None, False)
    raw = gzip.decompress(member)
    if harm == "cut":
        data = member[:-20]
    elif harm == "payload":
        data = gzip.compress(raw.replace(b"payload", b"payl0ad"))
    elif harm == "length":
        data = gzip.compress(raw[:-6])
    else:
        data = gzip.compress(raw + raw)
    with pytest.raises(ValueError):
        list(w.read_records(archive(data)))


def test_archives_roll(spark, tmp_path, monkeypatch):
    rows = pages(spark, [(i, "u", str(i) * 50) for i in range(20)]).coalesce(1)
    folder = f"file://{tmp_path}/w"
    monkeypatch.setattr(w, "ROLL_BYTES", 1000)
    run = w._write(folder)
    import pandas as pd

    frame = pd.DataFrame({"page_id": range(20), "url": "u", "html": [str(i) * 50 for i in range(20)], "revisit": False, "refers_to": None})
    done = pd.concat(list(run(iter([frame]))))
    assert len(done) > 1 and done["records"].sum() == rows.count()
    back = w.read_archives(spark.createDataFrame(done))
    assert sorted(r["page_id"] for r in back.collect()) == list(range(20))


def test_round_trip_equals_brute_force(spark, sf_dir, monkeypatch):
    """Against plain Python over all pages, with copies, nulls and one payload of many rows."""
    import base64
    import hashlib

    monkeypatch.setattr(w, "HOT_ROWS", 50)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(10_000 + i, "u", "one hot page é") for i in range(300)] + [(20_000 + i, None, rows[i][2]) for i in range(5)]
    rows += [(30_000, "v", None), (30_001, "v", "")]
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    want = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        lead = first[html or ""]
        want[i] = (len(raw), digest, "response" if lead == i else "revisit", None if lead == i else lead)
    found = w.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: tuple(r)[1:] for r in found} == want
