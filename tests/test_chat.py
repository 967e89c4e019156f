import json

from pyspark.sql import functions as F

from modq.operators import chat, moderate, streams


def requests(spark, dialect, body, path=""):
    return spark.createDataFrame([("r", dialect, path, {}, json.dumps(body))], "request_id string, dialect string, path string, headers map<string,string>, body string")


def said(spark, dialect, body):
    return chat.moderation_text_body(requests(spark, dialect, body)).first()["text"]


def test_body_texts(spark):
    """System texts first, then texts and tool results in order; images, reasoning and calls say nothing."""
    picture = {"type": "image_url", "image_url": {"url": "https://pictures.invalid/1.png"}}
    turns = [{"role": "system", "content": "be brief"}, {"role": "user", "content": [{"type": "text", "text": "part one"}, picture, {"type": "text", "text": "part two"}]}, {"role": "tool", "content": "never shown"}]
    assert said(spark, "openai_chat", {"messages": turns}) == "be brief\npart one\npart two"
    turns = [{"role": "user", "content": [{"type": "text", "text": "which way?"}]}, {"role": "assistant", "content": "north"}]
    assert said(spark, "claude_chat", {"system": [{"type": "text", "text": "a compass"}, {"type": "tool_use", "name": "n"}], "messages": turns}) == "a compass\nwhich way?\nnorth"
    items = [{"role": "user", "content": [{"type": "input_text", "text": "add these"}, {"type": "input_image"}, {"type": "input_text", "text": "and those"}]}, {"role": "assistant", "content": [{"type": "output_text", "text": "done so"}]}, {"type": "function_call_output", "output": "42 in all"}]
    assert said(spark, "openai_responses", {"instructions": "an abacus", "input": items}) == "an abacus\nadd these\nand those\ndone so\n42 in all"
    assert said(spark, "openai_responses", {"input": "only this"}) == "only this"


def test_bodies_that_cannot_be_read(spark):
    rows = spark.createDataFrame([("cut", "openai_chat", "", {}, '{"messages": [{"role"'), ("list", "claude_chat", "", {}, "[1, 2]"), ("none", "gemini_chat", "", {}, None), ("odd", "openai_chat", "", {}, '{"messages": [1, "x", {"role": "user", "content": "read"}]}')], "request_id string, dialect string, path string, headers map<string,string>, body string")
    assert {r["request_id"]: r["text"] for r in chat.explode_blocks(rows).collect()} == {"odd": "read"}


CALL = {"role": "assistant", "content": None, "tool_calls": [{"id": "k7", "function": {"name": "tide", "arguments": '{"port": "Brest"}'}}]}


def test_blocks_with_tools(spark):
    body = {"messages": [CALL, {"role": "tool", "tool_call_id": "k7", "content": "high at noon"}]}
    rows = chat.explode_blocks(requests(spark, "openai_chat", body)).orderBy("msg_seq").collect()
    assert [(r["kind"], r["call_id"], json.loads(r["payload"])) for r in rows] == [("tool_call", "k7", {"port": "Brest"}), ("tool_result", "k7", "high at noon")]
    back = json.loads(chat.chat_export(chat.explode_blocks(requests(spark, "openai_chat", body)), "claude_chat").first()["body"])
    assert back["messages"][0]["content"][0] == {"type": "tool_use", "id": "k7", "name": "tide", "input": {"port": "Brest"}}


def test_export_with_tools_and_options(spark):
    schema = {"type": "object", "properties": {"port": {"type": "string"}}, "required": ["port"]}
    body = {"messages": [{"role": "user", "content": "when?"}], "tools": [{"type": "function", "function": {"name": "tide", "description": "times", "parameters": schema}}, {"type": "function", "function": {"name": "moon"}}]}
    asked = requests(spark, "openai_chat", body)
    blocks, tools = chat.explode_blocks(asked), chat.explode_tools(asked)
    set_ = lambda **o: spark.createDataFrame([("r", *o.values())], "request_id string, " + ", ".join(f"{k} {chat.OPTIONS[k]}" for k in o))
    out = lambda target, **o: json.loads(chat.chat_export(blocks, target, tools=tools, options=set_(**o)).first()["body"])
    openai = out("openai_chat", tool_name="tide", max_tokens=9, stop=["END"])
    assert openai["tools"][0]["function"] == {"name": "tide", "description": "times", "parameters": schema}
    assert (openai["tool_choice"], openai["max_tokens"], openai["stop"]) == ({"type": "function", "function": {"name": "tide"}}, 9, ["END"])
    claude = out("claude_chat", tool_choice="required", temperature=0.5, stop=["END"])
    assert claude["tools"] == [{"name": "tide", "description": "times", "input_schema": schema}, {"name": "moon", "description": "", "input_schema": {"type": "object", "properties": {}}}]
    assert (claude["tool_choice"], claude["temperature"], claude["stop_sequences"]) == ({"type": "any"}, 0.5, ["END"])
    responses = out("openai_responses", tool_choice="auto", max_tokens=9, stop=["END"])
    assert responses["tools"][0]["parameters"] == schema and "stop" not in responses
    assert (responses["tool_choice"], responses["max_output_tokens"]) == ("auto", 9)
    gemini = out("gemini_chat", tool_name="moon", top_p=0.25, max_tokens=9)
    assert [d["name"] for d in gemini["tools"][0]["functionDeclarations"]] == ["tide", "moon"]
    assert gemini["toolConfig"] == {"functionCallingConfig": {"mode": "ANY", "allowedFunctionNames": ["moon"]}}
    assert gemini["generationConfig"] == {"maxOutputTokens": 9, "topP": 0.25}
    assert set(json.loads(chat.chat_export(blocks, "gemini_chat").first()["body"])) == {"contents"}


def test_dialects(spark):
    user = {"role": "user", "content": "name a colour"}
    cases = [
        ("claude_chat", "/gate/v1/messages", {"anthropic_version": "y", "messages": [user]}),
        ("openai_responses", "/gate/v1/responses", {"instructions": "one word", "input": [{"role": "user", "content": [{"type": "input_text", "text": "a colour"}]}]}),
        ("gemini_chat", "/v1beta/models/some-model:streamGenerateContent", {"contents": [{"role": "user", "parts": [{"text": "a colour"}]}]}),
        ("openai_chat", "/v1/chat/completions", {"messages": []}),
    ]
    for dialect, path, body in cases:
        assert chat.detect_dialect(requests(spark, None, body, path)).first()["dialect"] == dialect


def frames(spark, body, size, dialect="openai_responses"):
    return spark.createDataFrame([("s", i // size, dialect, body[i : i + size]) for i in range(0, len(body), size)], "stream_id string, seq long, dialect string, chunk string")


def event(kind, **data):
    return f"event: {kind}\ndata: {json.dumps({'type': kind} | data)}\n\n"


#: The call's arguments come before the call itself; the text names an end mark.
TEXT = 'say "data: [DONE]" and event: message_stop'
BODY = (
    event("response.created", response={"id": "z"})
    + event("response.output_text.delta", item_id="t1", delta=TEXT)
    + event("response.function_call_arguments.delta", item_id="f9", delta='{"port":')
    + event("response.function_call_arguments.delta", item_id="f9", delta='"Brest"}')
    + event("response.output_item.added", item={"type": "function_call", "id": "f9", "call_id": "k9", "name": "tide"})
    + event("response.completed", response={"status": "completed"})
    + "data: [DONE]\n\n"
)


def test_streams_cut_anywhere(spark):
    for size in (17, len(BODY)):
        r = streams.reassemble_streams(streams.frames_to_events(streams.chunks_to_frames(frames(spark, BODY, size)))).first()
        call = r["tool_calls"][0]
        assert (r["text"], r["finish_reason"], r["done"]) == (TEXT, "stop", True)
        assert (call["call_id"], call["name"], call["arguments"]) == ("k9", "tide", '{"port":"Brest"}')
        assert streams.stream_health(frames(spark, BODY, size)).first()["passes"]


def test_health_passes_above_the_bound_alone(spark):
    for size, passes in ((1047, False), (1048, False), (1049, True)):
        body = ": " + "x" * (size - 4) + "\n\n"
        r = streams.stream_health(frames(spark, body, size, "openai_chat")).first()
        assert (r["bytes"], r["passes"]) == (size, passes)


def test_short_stream_fails(spark):
    body = 'data: {"choices":[{"delta":{"content":"ok"}}]}\n\n'
    r = streams.stream_health(frames(spark, body, 9, "openai_chat")).first()
    assert not r["passes"] and "short" in r["message"]


def test_stream_with_state_equals_batch(spark, tmp_path):
    from modq.streaming import jobs

    rows = frames(spark, BODY, 17).selectExpr("*", "timestamp '2024-01-01' as ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.reassemble_streams_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["text"], r["tool_calls"][0]["name"], r["done"]) for r in rows] == [(TEXT, "tide", True)]


def test_chunks_that_come_one_by_one_give_one_row(spark, tmp_path):
    """An end mark inside a text, and chunks out of order, end nothing too early; each stream gives the row of the batch form."""
    from modq.streaming import jobs

    chat_body = f'data: {json.dumps({"choices": [{"delta": {"content": TEXT}}]})}\n\n' + 'data: {"choices":[{"delta":{"content":" and more"}}]}\n\n' + "data: [DONE]\n\n"
    claude = event("content_block_delta", index=0, delta={"type": "text_delta", "text": TEXT}) + event("message_stop")
    bodies = {"openai_responses": BODY.removesuffix("data: [DONE]\n\n"), "openai_chat": chat_body, "claude_chat": claude}
    schema = "stream_id string, seq long, dialect string, chunk string, ts timestamp"
    import datetime

    parts = [(d, i // 40, d, b[i : i + 40], datetime.datetime(2024, 1, 1)) for d, b in bodies.items() for i in range(0, len(b), 40)]
    parts = sorted(parts, key=lambda r: (r[1] % 3, r[1]))
    for n in range(3):
        spark.createDataFrame([r for r in parts if r[1] % 3 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.reassemble_streams_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["stream_id"], r["text"], r["done"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("claude_chat", TEXT, True), ("openai_chat", TEXT + " and more", True), ("openai_responses", TEXT, False)]


def test_every_request_gets_a_decision(spark):
    requests_ = spark.createDataFrame([(1, "a", None), (2, None, "some text"), (3, "a", "some text"), (4, None, None), (5, "a", ""), (6, None, "has a Needle")], "id long, profile string, text string")
    keywords = spark.createDataFrame([(0, "needle", "needle")], "pos int, original string, normalized string")
    history = spark.createDataFrame([("a", 1, "some text", 1, "c", "x")], "profile string, id long, text string, label int, category string, text_hash string").withColumn("text_hash", F.md5("text"))
    scorer = lambda t: t.select("id", F.lit(0.5).alias("p"))
    got = {r["id"]: (r["decision"], r["source"]) for r in moderate.moderate(requests_, keywords, scorer, history).collect()}
    assert got == {1: ("review", "review"), 2: ("review", "review"), 3: ("block", "history"), 4: ("review", "review"), 5: ("review", "review"), 6: ("block", "keyword")}


def test_keywords_and_bands(spark):
    keywords = spark.createDataFrame([(0, "unwanted saying", "unwanted saying"), (1, "saying", "saying")], "pos int, original string, normalized string")
    texts = spark.createDataFrame([(1, "An UNWANTED Saying, in capitals."), (2, "fine")], "id long, text string")
    got = {r["id"]: r["keyword_reason"] for r in moderate.keyword_block(texts, keywords).collect()}
    assert got == {1: "[BASIC_MODERATION_BLOCKED] Matched keyword: unwanted saying", 2: None}
    p = spark.createDataFrame([(1, 0.19), (2, 0.2), (3, 0.8), (4, 0.81), (5, None)], "id long, p double")
    assert [r["decision"] for r in moderate.decide(p).orderBy("id").collect()] == ["allow", "uncertain", "uncertain", "block", "skipped"]


def test_many_keywords_take_the_gram_path(spark):
    keywords = spark.createDataFrame([(i, f"nothing{i}", f"nothing{i}") for i in range(1001)] + [(2000, "Needle", "needle"), (2001, "zz", "zz")], "pos int, original string, normalized string")
    texts = spark.createDataFrame([(1, "a NEEDLE here"), (2, "fizzZZ"), (3, "none")], "id long, text string")
    assert {r["id"]: r["keyword"] for r in moderate.keyword_block(texts, keywords).collect()} == {1: "Needle", 2: "zz", 3: None}
