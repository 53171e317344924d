import gzip
import hashlib
import re

from quire.llm import arc_to_warc as arc

V1 = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n\n123456789\n"
HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhttp://fake/ 1.1.1.1 20010101000000 text/html 4\nbody"


def v1(url, block, date="20010203040506", length=None):
    return f"{url} 1.2.3.4 {date} text/html {len(block) if length is None else length}\n".encode() + block + b"\n"


def test_version_1_and_lengths():
    desc = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = v1("filedesc://x.arc", desc) + v1("http://h/a b?c d", HTTP) + v1("dns:h", b"20010101\nh. 1 IN A 1.1.1.1\n") + v1("ftp://h/f", b"")
    found = list(arc.records("s", data))
    assert [r["warc_type"] for r in found] == ["warcinfo", "response", "resource", "resource"]
    assert found[1]["target_uri"] == "http://h/a b?c d" and found[1]["content_length"] == len(HTTP)
    assert found[1]["payload_digest"] == arc.sha1(HTTP.split(b"\r\n\r\n", 1)[1]) and found[1]["block_digest"] == arc.sha1(HTTP)
    assert found[1]["warc_date"] == "2001-02-03T04:05:06Z" and found[3]["content_length"] == 0
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", r["record_id"]) for r in found)
    assert len({r["record_id"] for r in found}) == 4


def test_version_2():
    desc = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    line = f"http://h/ 1.2.3.4 19990101 text/html 200 abc - 12 x.arc {len(HTTP)}\n".encode()
    found = list(arc.records("s", v1("filedesc://x.arc", desc) + line + HTTP + b"\n"))
    assert [r["arc_version"] for r in found] == [2, 2] and found[1]["target_uri"] == "http://h/" and found[1]["warc_date"] == "1999-01-01T00:00:00Z"


def test_damage():
    good = v1("http://h/1", HTTP)
    found = list(arc.records("s", b"garbage line\nmore\n" + good + v1("http://h/2", b"short", length=99)))
    assert [r.get("warc_type") for r in found] == [None, "response", "response"] and found[0]["error"] == "garbage line"
    assert found[2]["truncated"] and found[2]["content_length"] == 6 and not found[1]["truncated"]
    assert list(arc.records("s", b"")) == [] and list(arc.records("s", b"\n\r\n")) == []


def test_gzip_members():
    parts = [v1("http://h/1", HTTP), v1("http://h/2", HTTP)]
    assert [r["target_uri"] for r in arc.records("s", b"".join(map(gzip.compress, parts)))] == ["http://h/1", "http://h/2"]
    assert [r["target_uri"] for r in arc.records("s", gzip.compress(parts[0]) + b"\x1f\x8bbroken")] == ["http://h/1"]


def test_rendering_round_trip():
    record = next(arc.records("s", v1("http://h/1", HTTP)))
    head, _, rest = arc.rendered(record, HTTP).partition(b"\r\n\r\n")
    names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.0") and rest == HTTP + b"\r\n\r\n" and int(names["Content-Length"]) == len(HTTP)
    import base64

    assert names["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(HTTP).digest()).decode()


def test_files_and_edges(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(v1("http://h/1", HTTP))
    assert arc.read(spark, str(tmp_path)).first().target_uri == "http://h/1"
    rows = [("a", bytearray(v1("http://h/1", HTTP)), 1), ("a", bytearray(v1("http://h/1", HTTP)), 1), (None, None, None), ("e", bytearray(), 2), (None, bytearray(v1("http://h/1", b"x" * 3_000_000)), 5)]
    df = spark.createDataFrame(rows, "source string, content binary, ordinal int")
    found = arc.convert(df).collect()
    assert len(found) == 3 and len({r.record_id for r in found}) == 2 and max(r.content_length for r in found) == 3_000_000
    assert arc.convert(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/x", None)], "page_id long, url string, html string")
    assert arc.convert(arc.arc_of(pages)).filter("error IS NOT NULL").count() == 0


def test_pages_without_an_id_are_converted(spark):
    pages = spark.createDataFrame([(None, "http://h/x", "a"), (0, "http://h/y", "b")], "page_id long, url string, html string")
    found = arc.convert(arc.arc_of(pages)).collect()
    assert sorted(r.source for r in found) == ["page-0.arc"] * 3 + ["page-null.arc"] * 3 and all(r.error is None for r in found)


def test_broken_members_in_the_middle():
    parts = [gzip.compress(v1(f"http://h/{k}", HTTP + b"x" * 5000 + hashlib.sha1(b"%d" % k).digest() * 50)) for k in range(4)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 255
    found = list(arc.records("s", parts[0] + bytes(bad) + parts[2] + parts[3]))
    assert [r["target_uri"] for r in found if r.get("warc_type") and not r["truncated"]][-2:] == ["http://h/2", "http://h/3"] and found[0]["target_uri"] == "http://h/0"
    assert [r["error"] for r in found if r.get("error")] == ["broken gzip member"] and [r["ordinal"] for r in found] == list(range(len(found)))
    cut = list(arc.records("s", parts[0] + parts[1][:-10]))
    assert cut[-1]["error"] == "broken gzip member" and cut[0]["target_uri"] == "http://h/0"
    assert [r.get("target_uri") for r in arc.records("s", parts[0] + b"\0\0\n" + parts[2])] == ["http://h/0", "http://h/2"]
    assert [r.get("target_uri") for r in arc.records("s", parts[0] + b"\0\0\n")] == ["http://h/0"]


def test_dates_that_do_not_exist():
    assert arc.iso_date("20011301000000") == "2001-01-01T00:00:00Z" and arc.iso_date("20010230256199") == "2001-02-01T00:00:00Z"
    assert arc.iso_date("1999") == "1999-01-01T00:00:00Z" and arc.iso_date("20000229235959123") == "2000-02-29T23:59:59Z" and arc.iso_date("00000000000000") == "0000-01-01T00:00:00Z"


def test_archives_of_many_records_are_written_and_read_back(spark, tmp_path):
    """Both versions, plain and gzipped, some damaged; the files are read by an independent reader."""
    desc = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    want, rows = [], []
    for a in range(12):
        parts = [v1("filedesc://x.arc", desc if a % 2 else b"1 0 Org\n")]
        for k in range(200):
            block = HTTP + b"%d %d " % (a, k) * (k % 50)
            line = f"http://h/{a}/{k} 1.2.3.4 19990101 text/html 200 abc - 12 x.arc {len(block)}\n".encode() if a % 2 else f"http://h/{a}/{k} 1.2.3.4 19990101 text/html {len(block)}\n".encode()
            parts.append(line + block + b"\n")
            want.append((f"http://h/{a}/{k}", block))
        if a % 5 == 4:
            parts.insert(50, b"no header at all\n")
        rows.append((f"a{a}", bytearray(b"".join(gzip.compress(p) for p in parts) if a % 3 == 0 else b"".join(parts))))
    found = arc.convert(spark.createDataFrame(rows, "source string, content binary").repartition(5))
    assert found.filter("error IS NOT NULL").count() == 2
    arc.write(found, f"file://{tmp_path}/warc")
    got = []
    for path in sorted((tmp_path / "warc").iterdir()):
        assert path.name.endswith(".warc.gz")
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(names["Content-Length"])
            assert head.startswith(b"WARC/1.0\r\n") and rest[n : n + 4] == b"\r\n\r\n" and names["WARC-Block-Digest"] == arc.sha1(rest[:n])
            if names["WARC-Type"] == "response":
                got.append((names["WARC-Target-URI"], rest[:n]))
            data = rest[n + 4 :]
    assert sorted(got) == sorted(want)
