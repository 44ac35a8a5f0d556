"""Web archives: round trips and damaged files."""

import base64
import hashlib
import random
import zlib

import pytest
from conftest import DATA, rows

from corpusdrift.llm import queries, shared, warc

SCHEMA = "page_id long, url string, html string, payload string, key int, revisit string, sum int, refers_to int"


def expected(pages, least=0):
    newest = {}
    for p, _, h in pages:
        if p is not None:
            newest[h or ""] = max(newest.get(h or "", p), p)
    out = []
    for p, _, h in pages:
        payload = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        last = newest.get(h or "")
        again = len(payload) >= least and last is not None and last != p
        out.append((p, len(payload), sha, "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_equals_brute_force(spark):
    pages = [tuple(r) for r in shared.table(spark, DATA, "pages").select("page_id", "url", "html").collect()]
    assert rows(queries.op6_warc(spark, DATA), *COLUMNS) == expected(pages)


@pytest.mark.parametrize("least", [0, 5])
def test_awkward_pages(spark, tmp_path, least):
    pages = [(1, None, None), (2, "u v\r\nw", ""), (3, "x", "WARC/1.1\r\n\r\n\r\nWARC/1.0 \x1f"), (3, "x", "other")]
    pages += [(4, "é", "same"), (9, "b", "same"), (9, "b", "same"), (None, "n", "same"), (None, None, "alone")]
    pages += [(20, "long", "y" * 3_000_000), (21, "z", "ünï" * 1000)]
    found = spark.createDataFrame([(*p, "x", 1, "r", 2, 3) for p in pages], SCHEMA)
    warc.write(found, str(tmp_path / "a"), least)
    read = warc.read(spark, str(tmp_path / "a"), with_payload=True)
    assert read.where("problem is not null").count() == 0
    assert rows(warc.page_records(read), *COLUMNS) == expected(pages, least)
    for r in read.where("record_type = 'response'").collect():
        assert warc.digest(bytes(r.payload)) == r.payload_digest
    warc.write(found.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).collect() == []


def archive(seed, count, packed):
    rng, parts = random.Random(seed), []
    for i in range(count):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(400))) + b"WARC/1.1 in a payload"
        parts.append(warc.record(i, f"http://x/{i}", payload, None, False))
    if packed:
        parts = [zlib.compress(p, wbits=31) for p in parts]
    return parts


def ids(found):
    return [x[3]["warc-record-id"] for x in found if x[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_damaged_archives(packed):
    for seed in range(40):
        parts, rng = archive(seed, 12, packed), random.Random(seed)
        bad = set(rng.sample(range(12), 3))
        broken = []
        for i, part in enumerate(parts):
            if i in bad:
                at = rng.randrange(len(part) // 2, len(part) - 6)
                part = rng.choice([part[:at], part[:at] + b"\x00\x01" + part[at + 2 :], b"junk" + part[40:]])
            broken.append(part)
        data = b"".join(broken)
        found = list(warc.salvage(data))
        good = {f"<urn:page:{i}>" for i in range(12) if i not in bad}
        assert good <= set(ids(found))
        # Every byte belongs to a record or to a logged gap.
        spans = sorted({x[1:3] for x in found})
        assert spans[0][0] == 0 and spans[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_sound_mixed_and_empty_archives():
    packed, plain = archive(1, 5, True), archive(2, 5, False)
    mixed = b"".join(packed + plain) + warc.EMPTY_MEMBER + zlib.compress(b"".join(plain), wbits=31)
    found = list(warc.salvage(mixed))
    assert len(found) == 15 and {x[0] for x in found} == {"record"}
    assert list(warc.salvage(b"")) == []
    assert [x[0] for x in warc.salvage(b"no archive at all")] == ["gap"]


def test_sound_records_of_a_damaged_member_are_kept():
    parts = archive(3, 12, False)
    every = [f"<urn:page:{i}>" for i in range(12)]
    spoiled = [*parts]
    spoiled[4] = spoiled[4].replace(b"in a payload", b"in a PAYLOAD")
    found = list(warc.salvage(zlib.compress(b"".join(spoiled), wbits=31)))
    assert ids(found) == every[:4] + every[5:] and [x[0] for x in found].count("gap") == 1
    packed = zlib.compress(b"".join(parts), wbits=31)
    cut = list(warc.salvage(packed[: len(packed) // 2] + zlib.compress(parts[0], wbits=31)))
    assert len(ids(cut)) >= 4 and ids(cut)[:3] == every[:3] and ids(cut)[-1] == every[0]
    tail = list(warc.salvage(packed[:-20]))
    assert ids(tail)[:11] == every[:11] and tail[0][0] == "gap"
    stored = zlib.compress(b"".join(parts), level=0, wbits=31)
    assert ids(warc.salvage(stored[:-6])) == every


def test_every_version_header_size_and_file_name(spark, tmp_path):
    parts = archive(4, 4, False)
    old = [p.replace(b"WARC/1.1\r\n", b"WARC/0.18\r\n", 1) for p in parts]
    assert len(ids(warc.salvage(b"junk" + b"".join(old)))) == 4
    wide = parts[0].replace(b"WARC-Date", b"X-Wide: " + b"y" * 1_200_000 + b"\r\nWARC-Date", 1)
    assert len(ids(warc.salvage(wide))) == 1
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "crawl.warc.gz").write_bytes(zlib.compress(parts[0], wbits=31))
    (tmp_path / "b" / "c" / "other.warc").write_bytes(parts[1])
    assert warc.read(spark, str(tmp_path / "b")).where("problem is null").count() == 2
