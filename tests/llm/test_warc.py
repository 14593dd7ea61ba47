import base64
import hashlib

from orrery.llm import warc
from orrery.llm.scratch import Scratch

PAGES = "page_id long, url string, html string, record_type string"


def test_round_trip_and_random_access(spark):
    rows = [(i, f"http://x.example/{i}?a=b c\r\nd", f"<p>{i % 7} é</p>" * (1 + 4000 * (i % 9 == 0)), "extra") for i in range(200)]
    rows += [(300, None, None, "e"), (301, "u", "", "e"), (None, "u", "only null", "e"), (None, "u", rows[5][2], "e"), (302, "u", "WARC/1.1\r\n\r\nx\r\n\r\n", "e"), (302, "u", "WARC/1.1\r\n\r\nx\r\n\r\n", "e"), (303, "u", "y" * 3_000_000, "e")]
    pages = spark.createDataFrame(rows, PAGES)
    expected = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        keeper = max((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        kind = "response" if page_id == keeper else "revisit"
        expected.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, keeper if kind == "revisit" else None))
    found = warc.round_trip(pages)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)

    scratch = Scratch(spark, "test")
    index = scratch.save(warc.write(pages, scratch.path("bundles")), "index").collect()
    assert len(index) == len(rows)
    html = {p: (h or "").encode() for p, _, h, _ in rows}
    names = []
    for x in index:
        head, payload = warc.fetch(x.bundle, x.frame, x.record_at, x.record_bytes)
        assert head.get(warc.PAGE) == (None if x.page_id is None else str(x.page_id)) and head["WARC-Type"] == x.record_type
        names.append(head["WARC-Record-ID"])
        if sum(r[0] == x.page_id for r in rows) == 1:
            assert names[-1] == f"<urn:orrery:page:{x.page_id}>"
        if x.record_type == "revisit":
            assert head.get("WARC-Refers-To", f"<urn:orrery:page:{head[warc.REFERS]}>") == f"<urn:orrery:page:{head[warc.REFERS]}>"
        if x.record_type == "response" and x.page_id is not None:
            assert payload == html[x.page_id]
    assert len(set(names)) == len(rows)


def test_small_payloads_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], PAGES)
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(pages, 3).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
