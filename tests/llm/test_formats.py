"""Chat formatting and media columns: exact round trips."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rankfield.llm import chat, media

PARTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "assistant", "é", "😀", "<\\|", "<\\\\|"]), max_size=12).map("".join)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chats_read_back(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\nok <\\|im_end|> <"
    rows = [
        (1, 1, "assistant", nasty, "x"), (1, 0, "user", nasty, None), (1, 2, "assistant", None, None), (2, 0, None, "", None), (2, 0, "a\n<%0A|", "|", None),
        (None, 5, "assistant", "nobody", None), (3, None, "assistant", "first", None), (3, 0, "assistant", "é😀", None), (3, 0, "assistant", "é😀", None),
    ]
    rows += [(9, i, "user" if i % 2 else "assistant", f"turn {i} " + "long " * 3000, None) for i in range(2000)]
    found = {r["conv_id"]: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(found) == {1, 2, 3, 9, None}
    for conv, row in found.items():
        key = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3]))
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert chat.read_turns(row["formatted"]) == want
        assert chat.read_loss(row["formatted"], row["loss"]) == "".join(text for role, text in want if role == "assistant")


def test_no_conversations(spark):
    assert chat.format_chats(turns(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_escape_is_reversible(text):
    import pyarrow as pa

    coded = chat.escape(pa.array([text], pa.large_string()))[0].as_py()
    assert "<|" not in coded and chat.unescape(coded) == text


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 255))
def test_streams_read_back(frames, byte):
    payload = bytes((byte + i * i) % 256 for i in range(frames * media.FRAME))
    found = media.parse_stream(media.write_stream(payload))
    assert found["payload"] == payload and found["continuity_errors"] == 0
    units = -(-frames // media.FRAMES)
    assert found["elementary_packets"] == units == len(found["random_access"])
    assert found["timestamps"] == [i * media.FRAMES * media.TICKS for i in range(units)]


def test_damaged_streams():
    whole = media.write_stream(bytes(media.FRAME * 20))
    lost = whole[: 5 * media.PACKET] + whole[6 * media.PACKET :]
    assert media.parse_stream(lost)["continuity_errors"] == 1
    twice = whole[: 6 * media.PACKET] + whole[5 * media.PACKET :]
    assert media.parse_stream(twice)["continuity_errors"] == 0 and media.parse_stream(twice)["payload"] == bytes(media.FRAME * 20)
    assert media.parse_stream(b"\0" * 400)["payload"] == b"" and media.parse_stream(None)["packets"] == 0
    broken = bytearray(whole)
    broken[20] ^= 1  # the association table's checksum no longer holds
    assert media.parse_stream(bytes(broken))["programs"] == ""


def test_media_table(awkward, no_rows, texts):
    found = media.index_media(media.store_media(awkward)).collect()
    want = []
    for doc, text in texts:
        data = text.encode()
        data += b"\xff" * ((-len(data)) % 576 if data else 576)
        want.append((str(doc), len(text.encode()), hashlib.sha256(data).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_bytes"], hashlib.sha256(r["payload"]).hexdigest()) for r in found) == sorted(want)
    assert media.index_media(media.store_media(no_rows)).collect() == []


def test_long_conversations_are_held_once(spark, monkeypatch):
    """Turns of one conversation over many buffers, a null id between others, all in one piece each."""
    monkeypatch.setattr(chat, "BUFFER_BYTES", 1 << 12)
    import pyarrow as pa

    ids = [1] * 300 + [2] + [3] * 40 + [None] * 500
    table = pa.table({"conv_id": pa.array(ids, pa.int64()), "role": ["user"] * len(ids), "text": [f"turn {i}" for i in range(len(ids))]})
    asked = []
    whole = chat.assemble
    monkeypatch.setattr(chat, "assemble", lambda turns: asked.append(len(turns)) or whole(turns))
    rows = [r for batch in chat._assemble_batches(iter(table.to_batches(max_chunksize=37))) for r in batch.to_pylist()]
    assert [(r["conv_id"], len(chat.read_turns(r["formatted"]))) for r in rows] == [(1, 300), (2, 1), (3, 40), (None, 500)]
    assert sum(asked) == len(ids)  # no turn was assembled twice


def test_every_stream_of_every_program_is_reassembled():
    """Two programs, the second with two streams, whose packets alternate."""
    program = lambda n, pid: n.to_bytes(2) + (0xE000 | pid).to_bytes(2)
    stream = lambda kind, pid: bytes([kind]) + (0xE000 | pid).to_bytes(2) + bytes([0xF0, 0])
    tables = [
        media._table_packet(0, media._section(0, 1, program(1, 0x100) + program(2, 0x200))),
        media._table_packet(0x100, media._section(2, 1, (0xE000 | 0x101).to_bytes(2) + bytes([0xF0, 0]) + stream(6, 0x101))),
        media._table_packet(0x200, media._section(2, 2, (0xE000 | 0x201).to_bytes(2) + bytes([0xF0, 0]) + stream(6, 0x201) + stream(15, 0x202))),
    ]
    payloads = {pid: bytes((pid + i * 7) % 256 for i in range(n * media.FRAME)) for pid, n in ((0x101, 20), (0x201, 9), (0x202, 31))}
    lanes = []
    for pid, payload in payloads.items():
        whole = media.write_stream(payload)
        packets = [bytearray(whole[i : i + media.PACKET]) for i in range(0, len(whole), media.PACKET)]
        packets = [p for p in packets if ((p[1] & 0x1F) << 8 | p[2]) == media.DATA_PID]
        for p in packets:
            p[1], p[2] = p[1] & 0xE0 | pid >> 8, pid & 0xFF
        lanes.append([bytes(p) for p in packets])
    mixed = [lane[i] for i in range(max(map(len, lanes))) for lane in lanes if i < len(lane)]
    found = media.parse_stream(b"".join(tables + mixed))
    assert found["programs"] == "1:06@257,2:06@513,2:0f@514" and found["continuity_errors"] == 0
    assert found["payload"] == payloads[0x101]
    assert [(s["program"], s["kind"], s["pid"], s["payload"]) for s in found["others"]] == [(2, 6, 0x201, payloads[0x201]), (2, 15, 0x202, payloads[0x202])]


def test_streams_can_be_entered_at_random_access_points():
    payload = bytes(range(256)) * 9 * media.FRAME
    whole = media.write_stream(payload[: media.FRAME * 80])
    for n, at in enumerate(media.parse_stream(whole)["random_access"]):
        rest = media.parse_stream(whole[(at - 2) * media.PACKET :])  # the tables stand right before
        assert rest["payload"] == payload[n * media.FRAMES * media.FRAME : media.FRAME * 80] and rest["continuity_errors"] == 0
