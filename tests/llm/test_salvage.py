"""Damaged archives: what is sound inside a damaged member comes back, and nothing inside a damaged block does."""

import gzip
import hashlib
import random
import zlib

import pytest

from lexigrove.llm import warc


def record(body, digest=True):
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\n" + (f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n" if digest else "")
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def blocks(data):
    return [x["block"] for x in warc.salvage(data) if "fields" in x]


def tiled(data):
    spans = sorted({(x["offset"], x["length"]) for x in warc.salvage(data)})
    return [o for o, _ in spans] == [0, *[o + n for o, n in spans]][: len(spans)] and sum(n for _, n in spans) == len(data)


rng = random.Random(11)
BODIES = [bytes(rng.choices(b"abcdefgh <>\n", k=rng.randrange(50, 400))) for _ in range(50)]
RECORDS = [record(b) for b in BODIES]


@pytest.mark.parametrize("level", [0, 1, 9])
def test_member_cut_short(level):
    data = gzip.compress(b"".join(RECORDS), level)
    assert blocks(data) == BODIES
    cut = data[:-20]
    assert blocks(cut)[:49] == BODIES[:49] and len(blocks(cut)) <= 50 and tiled(cut)
    rows = list(warc.salvage(cut + RECORDS[0]))
    assert [x["block"] for x in rows if "fields" in x][:49] == BODIES[:49] and rows[-1]["block"] == BODIES[0] and "gap" in rows[-2]


def test_bad_record_in_a_sound_member():
    bad = bytearray(RECORDS[20])
    bad[-10] ^= 1
    inner = b"".join(RECORDS[:20]) + bytes(bad) + b"".join(RECORDS[21:])
    rows = list(warc.salvage(gzip.compress(inner)))
    assert [x["block"] for x in rows if "fields" in x] == BODIES[:20] + BODIES[21:]
    gaps = [x for x in rows if "gap" in x]
    assert [(x["inner_offset"], x["inner_length"], x["gap"]) for x in gaps] == [(sum(map(len, RECORDS[:20])), len(bad), "block digest differs")]
    assert [x["inner_offset"] for x in rows] == [sum(map(len, RECORDS[:i])) for i in range(50)]
    last = list(warc.salvage(gzip.compress(inner + b"junk")))[-1]
    assert (last["inner_length"], last["gap"]) == (4, "no version line")


def test_altered_member():
    """Stored deflate: one byte altered costs one record, checksums show it, and records that no digest vouches for are not taken."""
    data = bytearray(gzip.compress(b"".join(RECORDS), 0))
    at = data.index(BODIES[30])
    data[at + 5] ^= 1
    assert blocks(bytes(data)) == BODIES[:30] + BODIES[31:] and tiled(bytes(data))
    plain = [record(b, digest=False) for b in BODIES]
    data = bytearray(gzip.compress(b"".join(plain), 0))
    data[data.index(BODIES[30]) + 5] ^= 1
    assert blocks(gzip.compress(b"".join(plain))) == BODIES and not any("inner_offset" in x for x in warc.salvage(bytes(data)) if "fields" in x)


def test_member_after_a_damaged_one():
    members = [gzip.compress(b"".join(RECORDS[i : i + 10])) for i in range(0, 50, 10)]
    for _ in range(60):
        hurt = bytearray(members[1])
        hurt[rng.randrange(20, len(hurt))] ^= 1 << rng.randrange(8)
        data = members[0] + bytes(hurt) + b"".join(members[2:])
        found = blocks(data)
        assert found[:10] == BODIES[:10] and found[-30:] == BODIES[20:] and tiled(data)
        assert set(found[10:-30]) <= set(BODIES[10:20])


def test_record_inside_a_damaged_block():
    page = record(b"<html>" + RECORDS[3] + b"</html>")
    hurt = bytearray(page)
    hurt[hurt.index(b"<html>") + 1] ^= 1
    for data, want in (((hurt + RECORDS[1]), [BODIES[1]]), (hurt, []), (RECORDS[1] + hurt + gzip.compress(RECORDS[2]), [BODIES[1], BODIES[2]])):
        assert blocks(bytes(data)) == want and tiled(bytes(data))
    assert blocks(gzip.compress(RECORDS[1] + bytes(hurt) + RECORDS[2])) == [BODIES[1], BODIES[2]]


def test_steps():
    """Records and version lines across the bounds of steps; a member that inflates to far more than it takes."""
    big = [record(b"x" * n) for n in (warc.STEP - 200, 3 * warc.STEP + 7, 1, 0)]
    noise = b"." * (warc.STEP - 5)
    rows = list(warc.salvage(gzip.compress(noise + b"".join(big) + b"." * 30)))
    assert [len(x["block"]) for x in rows if "fields" in x] == [warc.STEP - 200, 3 * warc.STEP + 7, 1, 0]
    assert [(x["inner_offset"], x["inner_length"]) for x in rows if "gap" in x] == [(0, len(noise)), (len(noise) + sum(map(len, big)), 30)]
    deflate = zlib.compressobj(9, wbits=31)
    bomb = b"".join(deflate.compress(b"\0" * (1 << 20)) for _ in range(64)) + deflate.flush()
    assert [(x["offset"], x["length"], x["gap"]) for x in warc.salvage(bomb)] == [(0, len(bomb), "member without records")]
    named = b"\x1f\x8b\x08\x1c" + b"\0" * 6 + b"\x02\x00ab" + b"name\0" + b"comment\0" + gzip.compress(RECORDS[0])[10:]
    assert blocks(named) == BODIES[:1] and list(warc.salvage(gzip.compress(b"")))[0]["gap"] == "member without records"
