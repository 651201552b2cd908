import random

import pytest

from wardline.llm import warc as W

KIND = "page_id bigint, url string, html string"


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://c d\n", ""), (5, "u", "é" * 50_000), (6, "u", "WARC/1.1\r\n\r\n"),
            (7, "u", "x"), (8, "u", "y"), (8, "u", "y"), (None, "u", "x"), (None, "u", "z")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", path int")
    got = W.read(W.write(pages, str(tmp_path))).collect()
    assert all(r["gap_reason"] is None for r in got)
    seen = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        head = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = head is not None and page != head
        want.append((page, len(data), W.digest(data), "revisit" if revisit else "response", head if revisit else None))
    assert seen == sorted(want, key=str)
    assert W.read(W.write(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_small_payloads_may_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], KIND)
    got = {r["page_id"]: r["record_type"] for r in W.read(W.write(pages, str(tmp_path), least_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def archive(path, packed):
    parts = []
    for k in range(40):
        data = f"page {k} ".encode() * (k + 1)
        text = W.record(k, f"http://h/{k}", data, W.digest(data), None, False)
        parts.append(W.member(text) if packed else text)
    path.write_bytes(b"".join(parts))
    return parts


def covered(found, size):
    at = 0
    for f in found:
        assert f.offset == at
        at += f.length
    assert at == size


def test_salvage_skips_damage_and_logs_it(tmp_path):
    for packed in (True, False):
        path = tmp_path / f"{packed}.warc"
        parts = archive(path, packed)
        starts = [sum(map(len, parts[:k])) for k in range(41)]
        whole = list(W.salvage(str(path)))
        assert [f.headers["warc-record-id"] for f in whole] == [f"<urn:page:{k}>" for k in range(40)]
        covered(whole, starts[-1])
        data = bytearray(path.read_bytes())
        data[starts[5] + 25] ^= 0xFF
        data[starts[9] + len(parts[9]) - 6] ^= 0x55
        data[starts[20] : starts[20] + 12] = b"garbage here"
        (tmp_path / "bad").write_bytes(bytes(data[: starts[39] + 15]))
        found = list(W.salvage(str(tmp_path / "bad")))
        covered(found, starts[39] + 15)
        names = {f.headers["warc-record-id"] for f in found if isinstance(f, W.Record)}
        lost = {int(n) for n in range(40)} - {int(n[10:-1]) for n in names}
        assert {9, 20, 39} <= lost <= {5, 9, 20, 39}
        assert all(g.reason for g in found if isinstance(g, W.Gap))


def test_salvage_of_noise_ends(tmp_path):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(200_000)) + b"WARC/1.1\r\n" + W.GZIP
    (tmp_path / "n").write_bytes(noise)
    found = list(W.salvage(str(tmp_path / "n")))
    assert [type(f) for f in found] == [W.Gap] and found[0].length == len(noise)
    (tmp_path / "e").write_bytes(b"")
    assert list(W.salvage(str(tmp_path / "e"))) == []


def test_urls_of_any_length_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/" + " " * 30_000, "x"), (2, "http://b/" + "u" * 700_000, "y"), (3, "http://c", "x")], KIND)
    manifest = W.write(pages, str(tmp_path))
    got = W.complete(W.read(manifest), manifest).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2, 3] and all(r["gap_reason"] is None for r in got)
    url = "http://a/" + "u" * 70_000
    (tmp_path / "plain").write_bytes(W.record(5, url, b"z", W.digest(b"z"), None, False) * 2)
    assert [f.headers["warc-target-uri"] for f in W.salvage(str(tmp_path / "plain"))] == [url, url]


def test_lost_pages_fail(spark, tmp_path):
    manifest = W.write(spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], KIND).coalesce(1), str(tmp_path))
    paths = [r["path"] for r in manifest.collect()]
    data = bytearray(open(paths[0], "rb").read())
    data[len(data) // 2 - 20] ^= 0xFF
    open(paths[0], "wb").write(bytes(data))
    with pytest.raises(RuntimeError, match="do not hold"):
        W.complete(W.read(manifest), manifest)
    with pytest.raises(RuntimeError, match="do not hold"):
        W.complete(W.read(manifest.limit(0)), manifest)
