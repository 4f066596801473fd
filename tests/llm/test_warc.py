import hashlib
import struct

import pytest

from parchmint.llm import warc as W

LONG = "<html>" + "é" * 60 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload", "3 AS first_id")


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_round_trip(spark, size):
    rows = [(i, f"http://x/{i}\r\nX: y", f"<p>{'text ' * i}</p>" + LONG * (i % 3)) for i in range(60)]
    rows += [(100, None, LONG), (101, "u", LONG), (99, "u", LONG), (99, "u", LONG), (102, "u", None), (103, "u", ""), (104, "u", "short"), (105, "u", "short"), (None, "u", LONG), (106, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (107, "u", "z" * 400_000)]
    archives = W.write_archives(pages(spark, rows).repartition(3), archive_bytes=size)
    got = W.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    bodies = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(bodies[p] == (h or "") for p, _, h in rows if p in bodies)
    assert {r.url for r in got} >= {"http://x/0%0D%0AX: y", None}
    head = bytes(archives.first().content)
    magic, n = struct.unpack_from("<II", head)
    assert magic == W.SKIPPABLE and 8 + n < len(head)


def test_dictionary_helps_and_files_are_equal(spark, tmp_path):
    rows = [(i, "u", "<html><head><title>page</title></head><body class='main'>" + str(i) * 30 + "</body></html>") for i in range(400)]
    archives = W.write_archives(pages(spark, rows).repartition(1))
    content = bytes(archives.first().content)
    import zstandard

    plain = sum(len(zstandard.compress(W.record(i, "u", h.encode(), "0" * 64, len(h), False, None, "d"))) for i, _, h in rows)
    assert len(content) < plain
    names = [r.archive for r in W.export(archives, str(tmp_path)).collect()]
    assert (tmp_path / names[0]).read_bytes() == content
    assert len(list(W.frames(content))) == 400


def test_damage_is_an_error():
    rec = W.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), 4, False, None, "d")
    with pytest.raises(ValueError):
        W.parse(rec.replace(b"body\r\n", b"bodX\r\n"))


def test_empty_table(spark):
    assert W.read_archives(W.write_archives(pages(spark, []))).collect() == []
