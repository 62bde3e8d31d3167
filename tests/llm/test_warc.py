import base64
import hashlib

import pytest

from foliomill.llm import queries, warc
from foliomill.sources import workspace


def archived(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int")
    folder = workspace.fresh(spark, "warc-test")
    warc.write(pages, folder, **options)
    return folder, warc.read(spark, folder)


ROWS = [
    (1, "http://a", "<p>é</p>", "x", 1), (2, "http://b", "<p>é</p>", "x", 1), (3, None, None, None, None),
    (4, "http://d\r\nX: y", "", None, None), (5, "http://e", "w" * 200_000, None, None), (None, "http://n", "<p>é</p>", "", 2),
    (2, "http://b", "<p>é</p>", "x", 1), (None, "http://n", "alone", "", 2),
]


def test_records_come_back(spark):
    folder, records = archived(spark, ROWS)
    rows = warc.described(records).collect()
    assert len(rows) == len(ROWS)
    payloads = {}
    for id_, _, html, *_ in ROWS:
        payloads.setdefault((html or "").encode(), []).append(id_)
    expected = []
    for payload, ids in payloads.items():
        owner = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for id_ in ids:
            revisit = owner is not None and id_ != owner
            expected.append((id_, len(payload), digest, "revisit" if revisit else "response", owner if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert all(r.stated_digest == "sha1:" + r.payload_digest for r in rows)
    assert spark.read.parquet(f"{folder}/payloads").count() == len(payloads)


def test_records_are_warc(spark):
    _, records = archived(spark, ROWS)
    for row in records.collect():
        head, _, rest = bytes(row.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        body = rest[:-4]
        assert len(body) == int(fields["Content-Length"])
        assert body == (b"" if fields["WARC-Type"] == "revisit" else bytes(row.payload))


def test_short_payloads_are_all_responses(spark):
    _, records = archived(spark, ROWS, shared_from=100)
    assert {r.record_type for r in warc.described(records).collect()} == {"response"}


def test_empty_table(spark):
    assert archived(spark, [])[1].count() == 0


def test_damage_is_found(spark):
    folder, _ = archived(spark, ROWS[:1])
    spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "encode('other', 'UTF-8') AS payload").write.parquet(f"{folder}/bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}/bad/headers")
    with pytest.raises(Exception, match="digest does not hold"):
        warc.read(spark, f"{folder}/bad").collect()


def test_query_agrees_with_brute_force_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    owner = {}
    for page, payload in pages:
        owner[payload] = max(page, owner.get(payload, page))
    expected = [(page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                 *(("response", None) if owner[payload] == page else ("revisit", owner[payload]))) for page, payload in pages]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in queries.QUERIES["op7_warc"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
