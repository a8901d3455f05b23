import base64
import hashlib


from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string"


def expected(rows):
    top = {}
    for i, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = i is not None and i < top[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"<p>page é {i} " + "words of the page " * (i % 40)) for i in range(300)] + [(900 + i, "copy\r\n\r\nWARC/1.1\r\n\x1d") for i in range(30)] + [(950, "copy\r\n\r\nWARC/1.1\r\n\x1d"), (1, None), (1, None), (2, ""), (None, "copy"), (7000, None)]
    pages = spark.createDataFrame([(i, f"http://a/{i} x\n", h, "clash") for i, h in rows], SCHEMA)
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w")
    have = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    assert have == expected(rows)
    assert all(r.payload == bytearray((dict(rows) if r.page_id != 1 else {1: None}).get(r.page_id, "") or "", "utf-8") for r in got.filter("record_type = 'response' and page_id > 2 and page_id < 900").collect())
    # Each file is one chain of Zstandard frames, led by the dictionary, with nothing behind it.
    import glob

    for f in glob.glob(f"{tmp_path}/w/part-*"):
        raw = open(f, "rb").read()
        assert raw[:4] == b"\x5d\x2a\x4d\x18" and raw[-9:] == b"\x50\x2a\x4d\x18\x01\x00\x00\x00\n"
        assert raw.count(b"\x28\xb5\x2f\xfd") >= len(list(warc.parse(raw)))


def test_threshold_empty_table_and_small_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa", ""), (2, "u", "aa", ""), (3, None, "aaaa", ""), (4, "u", "aaaa", "")], SCHEMA)
    warc.write(pages, f"{tmp_path}/w", min_payload=3)
    got = {r.page_id: r.refers_to for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    small = warc.archive([warc._record(1, "u", 2, "00" * 20, None, b"aa")])
    assert small[:4] == b"\x5d\x2a\x4d\x18" and [r[0] for r in warc.parse(small + b"\n")] == [1]
    warc.write(pages.limit(0), f"{tmp_path}/e")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.query(spark, sf).collect()), key=str) == expected(rows)
