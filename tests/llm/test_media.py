import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 3000, bytes(range(256)) * 20, os.urandom(64), os.urandom(media.FRAME), os.urandom(media.FRAME + 1), os.urandom(9 * media.FRAME + 7)])
@pytest.mark.parametrize("together", [256, 2])
def test_bytes_come_back(data, together, monkeypatch):
    monkeypatch.setattr(media, "TOGETHER", together)
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    avi = media.read_avi(media.write_avi(payload))
    planes = media.block_samples(avi.frames)
    assert b"".join(p.tobytes() for p in planes)[: len(payload)] == payload
    assert avi.info["ICMT"] == f"payload={len(payload)}" and avi.fps == 25


def test_frames_are_baseline_jpeg():
    frame = media.read_avi(media.write_avi(os.urandom(media.FRAME))).frames[0]
    plane = media.decode_frame(frame)
    assert plane.shape == (media.HIGH * 8, media.WIDE * 8)
    blocks = plane.reshape(media.HIGH, 8, media.WIDE, 8)
    assert (blocks == blocks[:, :1, :, :1]).all()
    assert (blocks[:, 0, :, 0].ravel() == media.block_samples([frame])[0]).all()


def coded(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_other_baseline_frames_are_decoded():
    """Two blocks with AC coefficients, own tables, and a restart between them."""
    quantiser = bytes([4] + [2] * 63)
    dc = bytes([0, 2] + [0] * 14) + bytes([0, 4])  # 00: 0 bits, 01: 4 bits
    ac = bytes([0, 3] + [0] * 14) + bytes([0x00, 0x02, 0xF0])  # 00: end, 01: 2 bits, 10: sixteen zeros
    block = "01" + "1010" + "01" + "11" + "10" + "01" + "00" + "00"  # dc 10, first ac 3, after sixteen zeros ac -3, end
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + quantiser) + media._segment(0xC0, struct.pack(">BHHB3B", 8, 8, 16, 1, 1, 0x11, 0))
    head += media._segment(0xC4, b"\0" + dc) + media._segment(0xC4, b"\x10" + ac) + media._segment(0xDD, b"\0\1") + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    plane = media.decode_frame(head + coded(block) + b"\xff\xd0" + coded(block) + b"\xff\xd9")
    u, want = np.zeros((8, 8)), np.zeros((8, 8))
    u[0, 0], u[0, 1] = 40, 6
    r, c = divmod(int(media.zigzag()[18]), 8)
    u[r, c] = -6
    for y in range(8):
        for x in range(8):
            want[y, x] = sum(u[j, i] * (0.5**0.5 if not i else 1) * (0.5**0.5 if not j else 1) / 4 * np.cos((2 * x + 1) * i * np.pi / 16) * np.cos((2 * y + 1) * j * np.pi / 16) for j in range(8) for i in range(8))
    assert plane.shape == (8, 16) and (plane[:, :8] == plane[:, 8:]).all()
    assert np.abs(plane[:, :8] - (want + 128)).max() <= 0.51


def test_zigzag():
    assert media.zigzag()[:11].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32] and sorted(media.zigzag()) == list(range(64))


def test_shots_follow_the_material():
    random = np.random.default_rng(3)
    dark = [random.integers(0, 60, media.FRAME).astype(np.uint8) for _ in range(10)]
    light = [random.integers(180, 255, media.FRAME).astype(np.uint8) for _ in range(7)]
    assert media.shots(dark + light + dark) == [(0, 10), (10, 17), (17, 27)]
    assert media.shots(dark) == [(0, 10)] and media.shots([]) == []


def test_clip_rows(spark):
    dark, light = bytes([20]) * media.FRAME * 5, bytes([220]) * media.FRAME * 5
    rows = [(1, media.write_avi(dark + light), "x"), (2, None, "x"), (3, media.write_avi(media.padded(b"")), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, media binary, first string")
    got = sorted((r.doc_id, r.clip, r.first, r.end, r.start_s, r.end_s) for r in media.clip_rows(docs).collect())
    assert got == [(1, 0, 0, 5, 0.0, 0.2), (1, 1, 5, 10, 0.2, 0.4), (3, 0, 0, 1, 0.0, 0.04)]


def test_texts_of_odd_rows(odd, nothing):
    rows = odd.select("text", media.stored(F.col("text")).alias("m")).withColumn("r", media.opened(F.col("m"))).collect()
    for r in rows:
        assert bytes(r.r.payload) == media.padded((r.text or "").encode())
    files = {(r.text or ""): hashlib.sha256(r.m).hexdigest() for r in rows}
    assert all(hashlib.sha256(r.m).hexdigest() == files[r.text or ""] for r in rows)
    assert nothing.select(media.stored(F.col("text"))).count() == 0


def test_files_without_an_index_and_wrong_files():
    whole = media.write_avi(media.padded(b"some text"))
    at = whole.rindex(b"idx1")
    assert media.read_avi(whole[:at]).frames == media.read_avi(whole).frames
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF\0\0\0\0WAVE")


def avi_of(frames, head=b"", index=None, movi=None):
    lists = media._chunk(b"LIST", b"hdrl" + head)
    body = media._chunk(b"LIST", b"movi" + (movi if movi is not None else b"".join(media._chunk(b"00dc", f) for f in frames)))
    return media._chunk(b"RIFF", b"AVI " + lists + body + (media._chunk(b"idx1", index) if index is not None else b""))


def plain_frame(value):
    """A frame of one flat block, without tables of its own: the usual ones have 1110 and 6 bits for a step of 33 to 63, 00 for none, 1010 for the end."""
    step = value - 128
    bits = ("1110" + f"{step if step > 0 else step + 63:06b}" if step else "00") + "1010"
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + media._segment(0xC0, struct.pack(">BHHB3B", 8, 8, 8, 1, 1, 0x11, 0)) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + coded(bits) + b"\xff\xd9"


def test_frames_without_tables_use_the_usual_ones():
    assert [int(media.decode_frame(plain_frame(v))[3, 3]) for v in (128, 168, 88)] == [128, 168, 88]
    assert sorted(len(t) for t in media.usual_tables().values()) == [12, 12, 162, 162]


def test_groups_further_segments_and_rates():
    frames = [plain_frame(v) for v in (128, 168, 88)]
    some = b"".join(media._chunk(b"00dc", f) for f in frames[:2])
    stream = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 2, 60, 0, 3, 0, 0, 0, 0, 0, 8, 8)
    head = media._chunk(b"LIST", b"strl" + media._chunk(b"strh", stream))
    more = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + media._chunk(b"00dc", frames[2])))
    avi = media.read_avi(avi_of([], head, movi=media._chunk(b"LIST", b"rec " + some)) + more)
    assert avi.frames == frames and avi.fps == 30
    wrong = struct.pack("<4s3I", b"00dc", 16, 99999, 4)
    assert media.read_avi(avi_of(frames, index=wrong)).frames == frames


def test_bad_files_have_a_row_that_says_so(spark):
    whole = media.write_avi(media.padded(b"some text"))
    odd = media.write_avi(media.padded(b"x")).replace(b"payload=64", b"payload=xy")
    rows = [(0, whole), (1, b""), (2, b"RIFF\0\0\0\0WAVE"), (3, whole[: len(whole) // 2]), (4, avi_of([b"\xff\xd8"])), (5, avi_of([plain_frame(128)])), (6, None), (7, odd), (8, avi_of([plain_frame(128)[:-4] + b"\xff\xd9"]))]
    rows += [(100 + i, whole[:i] + bytes([255]) + whole[i + 1 :]) for i in range(0, 400, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r.doc_id: r.r for r in docs.select("doc_id", media.opened(F.col("media")).alias("r")).collect()}
    assert bytes(got[0].payload) == media.padded(b"some text") and got[0].error is None
    for bad in (1, 2, 3, 4):
        assert got[bad].payload is None and got[bad].frames == 0 and got[bad].clips == [] and got[bad].error
    assert got[5].frames == 1 and got[5].fps == 0 and got[5].clips[0].start_s is None and got[6] is None and len(got[7].payload) == media.FRAME
    assert len(got) == len(rows) and media.clip_rows(docs).where("doc_id IN (1, 2, 3, 4)").count() == 0
