"""The kimi wire stream, fed in pieces out of order and restarted, against the fold of the whole."""

import json
import random

from tidemark.sources.transcripts import kimi_wire_messages
from tidemark.streaming import wire

RECORDS = "path string, line long, record string"


def talk(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["TurnBegin", "ContentPart", "ContentPart", "ToolCall", "ToolCall", "ToolCallPart", "ToolResult", "ToolResult", "Other"])
        call = rng.choice("abcd") + str(i // 12)
        payload = {
            "TurnBegin": {"user_input": [{"text": rng.choice(["go", " "])}]},
            "ContentPart": rng.choice([{"type": "think", "think": f"hm {i}"}, {"type": "text", "text": f"say {i}"}, {"type": "text", "text": ""}]),
            "ToolCall": {"id": call, "function": {"name": rng.choice(["Shell", "Grep", "SetTodoList"]), "arguments": rng.choice(["{", None])}},
            "ToolCallPart": {"arguments_part": f"p{i}"},
            "ToolResult": {"tool_call_id": rng.choice([call, "none", ""]), "return_value": rng.choice([f"out {i}", ""])},
        }.get(kind, {})
        out.append({"timestamp": 1_700_000_000 + i, "message": {"type": kind, "payload": payload}})
    return out


def test_stream_equals_the_fold(spark, tmp_path):
    rng = random.Random(1)
    whole = [(f"s{s}", i + 1, json.dumps(r)) for s in range(3) for i, r in enumerate(talk(s, 120))]
    # three pieces in order of time, with neighbours that change places over their borders
    order = sorted(whole, key=lambda r: r[1] + rng.uniform(-8, 8))
    pieces = [order[:120], order[120:240], order[240:]]
    closing = [(f"s{s}", 10_000, json.dumps({"timestamp": 1_800_000_000, "message": {"type": "TurnBegin", "payload": {"user_input": [{"text": "end"}]}}})) for s in range(3)]
    late = [("s0", 5, json.dumps({"timestamp": 1_600_000_000, "message": {"type": "ContentPart", "payload": {"type": "text", "text": "too late"}}}))]
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", wire.ROCKSDB)
    try:
        for i, rows in enumerate([*pieces, closing, late]):
            (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps(dict(zip(("path", "line", "record"), r, strict=True))) + "\n" for r in rows))
            stream = spark.readStream.schema(RECORDS).json(str(tmp_path / "in"))
            # every piece is a query of its own that goes on where the one before stopped
            query = wire.wire_parts(stream, "30 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert query.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = wire.messages(spark.read.schema(wire.PARTS).parquet(str(tmp_path / "out")))
    want = kimi_wire_messages(spark.createDataFrame(whole, RECORDS))
    part = lambda p: (p.kind, p.text, p.tool, p.call_id, p.arguments if p.kind == "tool" else None, p.outputs if p.kind == "tool" else None, p.at)
    told = lambda rows: [(r.session, r.seq, r.role, r.mode, r.message_id, r.at, [part(p) for p in r.parts]) for r in rows.orderBy("session", "seq").collect()]
    found = [r for r in told(got) if r[5] < 1_800_000_000_000]
    assert len(found) > 60 and found == told(want)
