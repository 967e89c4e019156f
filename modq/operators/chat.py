"""Chat requests and responses of four JSON dialects as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.functions.text import estimate_tokens, is_kind, items_of, json_of, string_of, trimmed

DIALECTS = ("gemini_chat", "openai_chat", "claude_chat", "openai_responses")
BLOCK = {"role": "string", "kind": "string", "text": "string", "call_id": "string", "name": "string", "payload": "string", "url": "string", "detail": "string"}
BLOCKS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in BLOCK.items()) + ">>"


def at(v: Column, path: str) -> Column:
    """The VARIANT at a path; null where it is absent."""
    return F.try_variant_get(v, path, "variant")


def has(v: Column, path: str) -> Column:
    return at(v, path).isNotNull()


def objects(items: Column) -> Column:
    return F.filter(items, lambda x: is_kind(x, "OBJECT"))


def either(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def parsed(requests: DataFrame) -> DataFrame:
    """requests with v: the body as VARIANT, null where it is no JSON."""
    return requests.withColumn("v", json_of(F.col("body")))


def _rules(path: Column, headers: Column, v: Column) -> dict[str, Column]:
    contents, messages = items_of(v, "$.contents"), items_of(v, "$.messages")
    gemini_body = either(is_kind(contents[0], "OBJECT") & has(contents[0], "$.parts")) & (F.coalesce(F.size(contents), F.lit(0)) > 0)
    role = string_of(contents[0], "$.role")
    path_has = lambda *parts: either(F.lit(False) if not parts else _any([F.contains(path, F.lit(p)) for p in parts]))
    cached = F.exists(objects(messages), lambda m: F.exists(F.coalesce(objects(items_of(m, "$.content")), F.array().cast("array<variant>")), lambda b: has(b, "$.cache_control")))
    refused = either(gemini_body) | (has(v, "$.prompt") & ~has(v, "$.messages")) | has(v, "$.system") | has(v, "$.anthropic_version") | either(cached) | is_kind(at(v, "$.thinking"), "OBJECT") | either(F.exists(items_of(v, "$.tools"), lambda t: has(t, "$.input_schema")))
    first = F.when(F.size(messages) > 0, messages[0])
    claude_refused = either(gemini_body) | either(F.exists(objects(messages), lambda m: either(string_of(m, "$.role") == "tool") | either(F.exists(items_of(m, "$.content"), lambda p: either(string_of(p, "$.type") == "image_url")))))
    return {
        "gemini_chat": path_has("generativelanguage.googleapis.com", "generateContent", "streamGenerateContent", "aistudio.google.com", "/v1beta/models/")
        | (gemini_body & is_kind(at(contents[0], "$.parts"), "ARRAY") & (either(role == "model") | (either(role == "user") & (has(v, "$.generationConfig") | has(v, "$.safetySettings"))))),
        "openai_chat": ~refused & (path_has("/chat/completions") | (is_kind(first, "OBJECT") & has(first, "$.role"))),
        "claude_chat": ~claude_refused
        & (path_has("/messages") | either(F.exists(F.map_keys(headers), lambda k: F.lower(k) == "anthropic-version")) | has(v, "$.anthropic_version") | is_kind(at(v, "$.messages"), "ARRAY") | is_kind(at(v, "$.messages"), "STRING") | is_kind(at(v, "$.prompt"), "STRING")),
        "openai_responses": path_has("/responses") | (has(v, "$.input") & has(v, "$.model")) | (either(string_of(v, "$.object") == "response") & has(v, "$.output")),
    }


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def detect_dialect(requests: DataFrame, candidates: tuple[str, ...] = DIALECTS) -> DataFrame:
    """requests with dialects (all of candidates that the request matches, in their order) and dialect (the first)."""
    rows = parsed(requests)
    rules = _rules(F.col("path"), F.col("headers"), F.col("v"))
    is_object = is_kind(F.col("v"), "OBJECT")
    found = F.filter(F.array(*[F.when(is_object & rules[c], F.lit(c)) for c in candidates]), lambda x: x.isNotNull())
    return rows.withColumn("dialects", found).withColumn("dialect", F.try_element_at("dialects", F.lit(1))).drop("v")


def hint_dialect(requests: DataFrame) -> DataFrame:
    """requests with hint: the first simple rule that holds, or null."""
    rows, v, path = parsed(requests), F.col("v"), F.col("path")
    hint = (
        F.when(either(path.contains("/v1/messages")) | has(v, "$.anthropic_version"), "claude_chat")
        .when(either(path.contains("/v1/responses")) | either(string_of(v, "$.object") == "response") | has(v, "$.input"), "openai_responses")
        .when(either(path.contains("/v1beta/models/")) | has(v, "$.contents"), "gemini_chat")
        .when(either(path.contains("/v1/chat/completions")) | has(v, "$.messages"), "openai_chat")
    )
    return rows.withColumn("hint", hint).drop("v")


def dialect_mismatch_report(requests: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """expected, detected, n for requests that match none of `allowed`."""
    rows = detect_dialect(requests)
    outside = rows.where(~F.arrays_overlap("dialects", F.array(*map(F.lit, allowed))))
    expected = "[" + ", ".join(f"'{a}'" for a in allowed) + "]"
    return outside.groupBy(F.coalesce("dialect", F.lit("none")).alias("detected")).agg(F.count("*").alias("n")).select(F.lit(expected).alias("expected"), "detected", "n")


def block(kind: str, role: Column | None = None, **fields: Column) -> Column:
    values = {"role": role, "kind": F.lit(kind)} | fields
    return F.struct(*[(F.lit(None) if values.get(n) is None else values[n]).cast(t).alias(n) for n, t in BLOCK.items()])


def no_blocks() -> Column:
    return F.array().cast(BLOCKS)


def strings_in(value: Column, depth: int = 3) -> Column:
    """All strings of a string or of an array nested up to depth, in order."""
    own = F.when(is_kind(value, "STRING"), F.array(string_of(value)))
    if depth:
        own = own.when(is_kind(value, "ARRAY"), F.flatten(F.transform(items_of(value), lambda x: strings_in(x, depth - 1))))
    return own.otherwise(F.array().cast("array<string>"))


def joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def _texts_of_type(items: Column, *types: str) -> Column:
    return F.filter(F.transform(F.filter(objects(items), lambda p: either(string_of(p, "$.type").isin(*types))), lambda p: string_of(p, "$.text")), lambda t: t.isNotNull())


def _result(output: Column, call_id: Column, name: Column | None = None) -> Column:
    return block("tool_result", text=joined(strings_in(output)), call_id=F.coalesce(call_id, F.lit("")), name=name, payload=F.coalesce(F.to_json(output), F.lit('""')))


def _arguments(value: Column) -> Column:
    """Arguments as JSON text: a string that holds JSON counts as that JSON."""
    return F.coalesce(F.to_json(json_of(string_of(value))), F.to_json(value), F.lit("{}"))


def _openai_message(m: Column) -> Column:
    role = F.coalesce(string_of(m, "$.role"), F.lit("user"))
    content = at(m, "$.content")

    def part(p: Column) -> Column:
        kind, url = string_of(p, "$.type"), string_of(p, "$.image_url.url")
        return F.when(kind == "text", block("text", text=F.coalesce(string_of(p, "$.text"), F.lit("")))).when((kind == "image_url") & url.isNotNull(), block("image", url=url, detail=string_of(p, "$.image_url.detail")))

    own = (
        F.when(role == "tool", F.array(_result(F.coalesce(content, F.parse_json(F.lit('""'))), string_of(m, "$.tool_call_id"), string_of(m, "$.name"))))
        .when(either(string_of(content) != ""), F.array(block("text", text=string_of(content))))
        .when(is_kind(content, "ARRAY"), F.filter(F.transform(objects(items_of(content)), part), lambda b: b.isNotNull()))
        .otherwise(no_blocks())
    )
    calls = F.transform(objects(items_of(m, "$.tool_calls")), lambda c: block("tool_call", call_id=F.coalesce(string_of(c, "$.id"), F.lit("")), name=F.coalesce(string_of(c, "$.function.name"), F.lit("")), payload=_arguments(at(c, "$.function.arguments"))))
    return _message(role, F.concat(own, F.coalesce(calls, no_blocks())))


def _message(role: Column, blocks: Column) -> Column:
    """Blocks of one message with its role; an empty message gets one empty text."""
    full = F.when(F.size(blocks) == 0, F.array(block("text", text=F.lit("")))).otherwise(blocks)
    return F.transform(full, lambda b: b.withField("role", role))


def _claude_message(m: Column) -> Column:
    role = F.when(either(string_of(m, "$.role") == "user"), "user").otherwise("assistant")
    content = at(m, "$.content")

    def part(p: Column) -> Column:
        kind, result = string_of(p, "$.type"), at(p, "$.content")
        texts = F.array_join(_texts_of_type(items_of(result), "text"), "\n")
        output = F.when(is_kind(result, "ARRAY"), F.parse_json(F.to_json(F.array(texts)))).otherwise(F.coalesce(result, F.parse_json(F.lit('""'))))
        inputs = at(p, "$.input")
        return (
            F.when(kind == "text", block("text", text=F.coalesce(string_of(p, "$.text"), F.lit(""))))
            .when(kind == "thinking", block("text", text=F.coalesce(string_of(p, "$.thinking"), F.lit(""))))
            .when(kind == "tool_use", block("tool_call", call_id=F.coalesce(string_of(p, "$.id"), F.lit("")), name=F.coalesce(string_of(p, "$.name"), F.lit("")), payload=F.when(is_kind(inputs, "OBJECT"), F.to_json(inputs)).otherwise("{}")))
            .when(kind == "tool_result", _result(output, string_of(p, "$.tool_use_id")))
        )

    parts = F.when(is_kind(content, "OBJECT"), F.array(content)).otherwise(objects(items_of(content)))
    own = F.when(is_kind(content, "STRING"), F.array(block("text", text=string_of(content)))).when(parts.isNotNull(), F.filter(F.transform(parts, part), lambda b: b.isNotNull())).otherwise(no_blocks())
    return _message(role, own)


def _responses_item(i: Column) -> Column:
    kind = F.coalesce(string_of(i, "$.type"), F.lit("message"))
    content = at(i, "$.content")
    url = lambda p: F.coalesce(string_of(p, "$.image_url.url"), string_of(p, "$.image_url"))

    def part(p: Column) -> Column:
        t = string_of(p, "$.type")
        return F.when(t.isin("text", "input_text", "output_text"), block("text", text=F.coalesce(string_of(p, "$.text"), F.lit("")))).when((t == "input_image") & url(p).isNotNull(), block("image", url=url(p), detail=string_of(p, "$.detail")))

    texts = F.when(is_kind(content, "STRING"), F.array(block("text", text=string_of(content)))).when(is_kind(content, "ARRAY"), F.filter(F.transform(objects(items_of(content)), part), lambda b: b.isNotNull())).otherwise(no_blocks())
    call = F.coalesce(string_of(i, "$.call_id"), string_of(i, "$.id"), F.lit(""))
    return (
        F.when(kind == "function_call", _message(F.lit("assistant"), F.array(block("tool_call", call_id=call, name=F.coalesce(string_of(i, "$.name"), F.lit("")), payload=_arguments(at(i, "$.arguments"))))))
        .when(kind == "function_call_output", _message(F.lit("tool"), F.array(_result(F.coalesce(at(i, "$.output"), F.parse_json(F.lit('""'))), call))))
        .when(kind == "reasoning", _message(F.lit("assistant"), F.array(block("text", text=F.array_join(F.filter(F.transform(objects(items_of(i, "$.summary")), lambda s: string_of(s, "$.text")), lambda t: t.isNotNull()), "\n")))))
        .otherwise(_message(F.coalesce(string_of(i, "$.role"), F.lit("user")), texts))
    )


def _gemini_content(c: Column) -> Column:
    role = F.when(either(string_of(c, "$.role") == "model"), "assistant").otherwise(F.coalesce(string_of(c, "$.role"), F.lit("user")))

    def part(p: Column) -> Column:
        call, answer = at(p, "$.functionCall"), at(p, "$.functionResponse")
        inline = at(p, "$.inlineData")
        return (
            F.when(string_of(p, "$.text").isNotNull(), block("text", text=string_of(p, "$.text")))
            .when(is_kind(call, "OBJECT"), block("tool_call", call_id=F.coalesce(string_of(call, "$.id"), string_of(call, "$.name"), F.lit("")), name=F.coalesce(string_of(call, "$.name"), F.lit("")), payload=F.coalesce(F.to_json(at(call, "$.args")), F.lit("{}"))))
            .when(is_kind(answer, "OBJECT"), _result(F.coalesce(at(answer, "$.response"), F.parse_json(F.lit("{}"))), F.coalesce(string_of(answer, "$.id"), string_of(answer, "$.name")), string_of(answer, "$.name")))
            .when(is_kind(inline, "OBJECT"), block("image", url=F.concat(F.lit("data:"), F.coalesce(string_of(inline, "$.mimeType"), F.lit("")), F.lit(";base64,"), F.coalesce(string_of(inline, "$.data"), F.lit("")))))
        )

    return _message(role, F.filter(F.transform(objects(items_of(c, "$.parts")), part), lambda b: b.isNotNull()))


def explode_blocks(requests: DataFrame) -> DataFrame:
    """blocks: request_id, msg_seq, block_seq, role, kind (text, tool_call, tool_result, image), text, call_id, name, payload (JSON), url, detail.

    requests need request_id, dialect, body. Every dialect is read where its rows stand: no shuffle.
    """
    v = F.col("v")
    messages_of = lambda path, read: F.coalesce(F.transform(objects(items_of(v, path)), read), F.array().cast(f"array<{BLOCKS}>"))
    one = lambda role, text: F.when(F.coalesce(text, F.lit("")) != "", F.array(_message(F.lit(role), F.array(block("text", text=text))))).otherwise(F.array().cast(f"array<{BLOCKS}>"))
    system = F.when(is_kind(at(v, "$.system"), "STRING"), string_of(v, "$.system")).otherwise(F.array_join(_texts_of_type(items_of(v, "$.system"), "text"), "\n"))
    given = F.coalesce(F.when(is_kind(at(v, "$.messages"), "STRING"), items_of(F.try_parse_json(string_of(v, "$.messages")))), items_of(v, "$.messages"))
    claude = F.concat(one("system", system), F.coalesce(F.transform(objects(given), _claude_message), F.array().cast(f"array<{BLOCKS}>")))
    prompt_only = is_kind(at(v, "$.prompt"), "STRING") & ~has(v, "$.messages")
    claude = F.when(prompt_only, F.concat(one("system", system), one("user", string_of(v, "$.prompt")))).otherwise(claude)
    inputs = at(v, "$.input")
    listed = F.when(is_kind(inputs, "OBJECT"), F.array(inputs)).otherwise(objects(items_of(inputs)))
    items = F.coalesce(F.transform(listed, _responses_item), F.array().cast(f"array<{BLOCKS}>"))
    responses = F.concat(one("system", trimmed(string_of(v, "$.instructions"))), F.when(is_kind(inputs, "STRING"), one("user", string_of(inputs))).otherwise(items))
    instruction = F.coalesce(at(v, "$.systemInstruction"), at(v, "$.system_instruction"))
    told = F.array_join(F.filter(F.transform(objects(items_of(instruction, "$.parts")), lambda p: string_of(p, "$.text")), lambda t: t.isNotNull()), "\n")
    gemini = F.concat(one("system", F.coalesce(told, string_of(instruction))), messages_of("$.contents", _gemini_content))
    by = F.when(F.col("dialect") == "openai_chat", messages_of("$.messages", _openai_message)).when(F.col("dialect") == "claude_chat", claude).when(F.col("dialect") == "openai_responses", responses).when(F.col("dialect") == "gemini_chat", gemini)
    messages = parsed(requests.select("request_id", "dialect", "body")).select("request_id", F.posexplode(by).alias("msg_seq", "m"))
    return messages.select("request_id", "msg_seq", F.posexplode("m").alias("block_seq", "b")).select("request_id", "msg_seq", "block_seq", "b.*")


def explode_tools(requests: DataFrame) -> DataFrame:
    """tools: request_id, seq, name, description, input_schema (JSON) of the four dialects' definitions."""
    v = F.col("v")
    tools = objects(items_of(v, "$.tools"))
    each = lambda t, base, schema: F.struct(string_of(t, f"{base}.name").alias("name"), F.coalesce(string_of(t, f"{base}.description"), F.lit("")).alias("description"), F.coalesce(F.to_json(at(t, f"{base}.{schema}")), F.lit("{}")).alias("input_schema"))
    by = (
        F.when(F.col("dialect") == "openai_chat", F.transform(tools, lambda t: each(t, "$.function", "parameters")))
        .when(F.col("dialect") == "claude_chat", F.transform(tools, lambda t: each(t, "$", "input_schema")))
        .when(F.col("dialect") == "openai_responses", F.transform(tools, lambda t: each(t, "$", "parameters")))
        .when(F.col("dialect") == "gemini_chat", F.flatten(F.transform(tools, lambda t: F.transform(objects(items_of(t, "$.functionDeclarations")), lambda d: each(d, "$", "parameters")))))
    )
    rows = parsed(requests.select("request_id", "dialect", "body")).select("request_id", F.posexplode(F.filter(by, lambda t: t["name"].isNotNull())).alias("seq", "t"))
    return rows.select("request_id", "seq", "t.*")


def drop_tool_blocks(blocks: DataFrame) -> DataFrame:
    """blocks without tool messages and tool blocks; a message that loses all keeps one empty text."""
    others = blocks.where("role <> 'tool'")
    kept = others.where("kind not in ('tool_call', 'tool_result')")
    emptied = others.select("request_id", "msg_seq", "role").distinct().join(kept.select("request_id", "msg_seq").distinct(), ["request_id", "msg_seq"], "left_anti")
    blank = emptied.select("request_id", "msg_seq", F.lit(0).alias("block_seq"), "role", F.lit("text").alias("kind"), F.lit("").alias("text"))
    return kept.unionByName(blank, allowMissingColumns=True)


def moderation_text_blocks(blocks: DataFrame) -> DataFrame:
    """request_id, text: texts and tool results in order, empty ones left out, joined by newlines."""
    said = F.when(F.col("kind").isin("text", "tool_result") & (F.col("text") != ""), F.struct("msg_seq", "block_seq", "text"))
    grouped = blocks.groupBy("request_id").agg(F.array_sort(F.collect_list(said)).alias("t"))
    return grouped.select("request_id", F.array_join(F.transform("t", lambda x: x.text), "\n").alias("text"))


def moderation_text_body(requests: DataFrame) -> DataFrame:
    """requests with text: what a body of its dialect says, read directly; other dialects go by openai_chat's rule."""
    v = F.col("v")
    none = F.array().cast("array<string>")

    def parts(value: Column, *types: str, depth: int = 1) -> Column:
        typed = F.flatten(F.transform(F.filter(items_of(value), lambda p: either(string_of(p, "$.type").isin(*types))), lambda p: strings_in(at(p, "$.text"))))
        out = F.when(is_kind(value, "STRING"), F.array(string_of(value))).when(is_kind(value, "ARRAY"), typed)
        if depth:
            out = out.when(is_kind(value, "OBJECT"), F.when(has(value, "$.content"), parts(at(value, "$.content"), *types, depth=depth - 1)).otherwise(strings_in(at(value, "$.text"))))
        return F.coalesce(out.otherwise(none), none)

    three = ("text", "input_text", "output_text")
    message = lambda m: F.when(either(string_of(m, "$.role") == "tool"), none).when(has(m, "$.content"), parts(at(m, "$.content"), *three)).otherwise(parts(at(m, "$.text"), *three))
    openai = joined(F.concat(parts(at(v, "$.system"), *three), parts(at(v, "$.instructions"), *three), F.coalesce(F.flatten(F.transform(items_of(v, "$.messages"), message)), none)))
    claude = joined(F.concat(parts(at(v, "$.system"), "text", depth=0), F.coalesce(F.flatten(F.transform(items_of(v, "$.messages"), lambda m: parts(at(m, "$.content"), "text", depth=0))), none)))

    def content(c: Column) -> Column:
        inner = F.flatten(F.transform(items_of(c), lambda p: F.when(either(string_of(p, "$.type").isin(*three)), strings_in(at(p, "$.text"))).when(either(string_of(p, "$.type") == "function_call_output"), strings_in(at(p, "$.output"))).otherwise(none)))
        return F.coalesce(F.when(is_kind(c, "STRING"), F.array(string_of(c))).when(is_kind(c, "ARRAY"), inner), none)

    def item(i: Column) -> Column:
        own = F.when(has(i, "$.content"), content(at(i, "$.content"))).otherwise(strings_in(at(i, "$.text")))
        output = F.when(either(string_of(i, "$.type") == "function_call_output"), strings_in(at(i, "$.output"))).otherwise(none)
        return F.when(is_kind(i, "OBJECT"), F.concat(own, output)).otherwise(strings_in(i))

    inputs = at(v, "$.input")
    listed = F.when(is_kind(inputs, "STRING"), F.array(string_of(inputs))).when(is_kind(inputs, "ARRAY"), F.flatten(F.transform(items_of(inputs), item))).when(is_kind(inputs, "OBJECT"), item(inputs)).otherwise(none)
    direct = joined(F.concat(F.coalesce(strings_in(at(v, "$.instructions")), none), F.coalesce(strings_in(at(v, "$.prompt")), none), F.coalesce(listed, none)))
    responses = F.when(direct != "", direct).when(has(v, "$.messages"), openai).otherwise("")
    text = F.when(F.col("dialect") == "claude_chat", claude).when(F.col("dialect") == "openai_responses", responses).otherwise(openai)
    return parsed(requests).withColumn("text", F.coalesce(text, F.lit(""))).drop("v")


def prompt_token_report(requests: DataFrame) -> DataFrame:
    """dialect, requests, tokens, average, median of the token estimate over the extracted text."""
    rows = moderation_text_body(requests).withColumn("tokens", estimate_tokens(F.col("text")))
    return rows.groupBy("dialect").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("average"), F.percentile_approx("tokens", 0.5).alias("median"))


CALLS = "array<struct<call_id:string,name:string,arguments:string>>"


def normalize_responses(responses: DataFrame) -> DataFrame:
    """response_id, dialect, text, reasoning, tool_calls, status, input_tokens, output_tokens, total_tokens, parse_error."""
    v, d = F.col("v"), F.col("dialect")
    none = F.array().cast("array<string>")
    call = lambda i, n, a: F.struct(F.coalesce(i, F.lit("")).alias("call_id"), F.coalesce(n, F.lit("")).alias("name"), F.coalesce(a, F.lit("{}")).alias("arguments"))
    lines = lambda a: F.array_join(F.filter(F.coalesce(a, none), lambda t: t.isNotNull()), "\n")
    number = lambda path: F.try_variant_get(v, path, "bigint")
    typed = lambda items, kind: F.filter(objects(items), lambda b: either(string_of(b, "$.type") == kind))

    message = at(v, "$.choices[0].message")
    openai = {
        "text": F.coalesce(string_of(message, "$.content"), lines(_texts_of_type(items_of(message, "$.content"), "text"))),
        "reasoning": F.coalesce(string_of(message, "$.reasoning_content"), F.lit("")),
        "tool_calls": F.transform(objects(items_of(message, "$.tool_calls")), lambda t: call(string_of(t, "$.id"), string_of(t, "$.function.name"), F.coalesce(string_of(t, "$.function.arguments"), F.to_json(at(t, "$.function.arguments"))))),
        "status": F.when(string_of(v, "$.choices[0].finish_reason") == "length", "incomplete").when(string_of(v, "$.choices[0].finish_reason") == "error", "failed").otherwise("completed"),
        "input_tokens": number("$.usage.prompt_tokens"), "output_tokens": number("$.usage.completion_tokens"), "total_tokens": number("$.usage.total_tokens"),
        "parse_error": F.when(~is_kind(message, "OBJECT"), "no choice"),
    }
    content = items_of(v, "$.content")
    claude = {
        "text": lines(_texts_of_type(content, "text")),
        "reasoning": lines(F.transform(typed(content, "thinking"), lambda b: string_of(b, "$.thinking"))),
        "tool_calls": F.transform(typed(content, "tool_use"), lambda b: call(string_of(b, "$.id"), string_of(b, "$.name"), F.to_json(at(b, "$.input")))),
        "status": F.when(string_of(v, "$.stop_reason") == "max_tokens", "incomplete").when(string_of(v, "$.stop_reason") == "error", "failed").otherwise("completed"),
        "input_tokens": number("$.usage.input_tokens"), "output_tokens": number("$.usage.output_tokens"),
        "total_tokens": F.coalesce(number("$.usage.total_tokens"), number("$.usage.input_tokens") + number("$.usage.output_tokens")),
        "parse_error": F.when(content.isNull(), "no content"),
    }
    output = items_of(v, "$.output")
    in_message = lambda m: F.coalesce(items_of(m, "$.content"), items_of(m, "$.content.items"), F.when(is_kind(at(m, "$.content"), "OBJECT"), F.array(at(m, "$.content"))))
    responses_ = {
        "text": lines(F.flatten(F.transform(typed(output, "message"), lambda m: F.coalesce(_texts_of_type(in_message(m), "output_text"), none)))),
        "reasoning": lines(F.flatten(F.transform(typed(output, "reasoning"), lambda r: F.coalesce(F.transform(objects(items_of(r, "$.summary")), lambda s: string_of(s, "$.text")), none)))),
        "tool_calls": F.transform(typed(output, "function_call"), lambda c: call(F.coalesce(string_of(c, "$.call_id"), string_of(c, "$.id")), string_of(c, "$.name"), string_of(c, "$.arguments"))),
        "status": F.coalesce(string_of(v, "$.status"), F.lit("completed")),
        "input_tokens": number("$.usage.input_tokens"), "output_tokens": number("$.usage.output_tokens"), "total_tokens": number("$.usage.total_tokens"),
        "parse_error": F.when(output.isNull(), "no output"),
    }
    parts = objects(items_of(v, "$.candidates[0].content.parts"))
    thought = lambda p: F.coalesce(F.try_variant_get(p, "$.thought", "boolean"), F.lit(False))
    produced = number("$.usageMetadata.candidatesTokenCount") + F.coalesce(number("$.usageMetadata.thoughtsTokenCount"), F.lit(0))
    gemini = {
        "text": lines(F.transform(F.filter(parts, lambda p: ~thought(p)), lambda p: string_of(p, "$.text"))),
        "reasoning": lines(F.transform(F.filter(parts, thought), lambda p: string_of(p, "$.text"))),
        "tool_calls": F.transform(F.filter(parts, lambda p: is_kind(at(p, "$.functionCall"), "OBJECT")), lambda p: call(F.coalesce(string_of(p, "$.functionCall.id"), F.lit("gemini_call")), string_of(p, "$.functionCall.name"), F.to_json(at(p, "$.functionCall.args")))),
        "status": F.when(string_of(v, "$.candidates[0].finishReason") == "MAX_TOKENS", "incomplete").when(string_of(v, "$.candidates[0].finishReason") == "ERROR", "failed").otherwise("completed"),
        "input_tokens": number("$.usageMetadata.promptTokenCount"), "output_tokens": produced,
        "total_tokens": F.coalesce(number("$.usageMetadata.totalTokenCount"), number("$.usageMetadata.promptTokenCount") + produced),
        "parse_error": F.when(~is_kind(at(v, "$.candidates[0]"), "OBJECT"), "no candidate"),
    }
    by = {"openai_chat": openai, "claude_chat": claude, "openai_responses": responses_, "gemini_chat": gemini}
    kinds = {"tool_calls": CALLS, "input_tokens": "bigint", "output_tokens": "bigint", "total_tokens": "bigint"}

    def pick(name: str) -> Column:
        out = F
        for dialect, columns in by.items():
            out = out.when(d == dialect, columns[name].cast(kinds.get(name, "string")))
        default = F.array().cast(CALLS) if name == "tool_calls" else F.lit("unknown dialect") if name == "parse_error" else F.lit(None).cast(kinds.get(name, "string"))
        value = out.otherwise(default)
        return F.coalesce(value, F.array().cast(CALLS)) if name == "tool_calls" else value

    rows = responses.withColumn("v", json_of(F.col("body")))
    return rows.select("response_id", "dialect", *[pick(n).alias(n) for n in openai])


def empty_response_flags(responses: DataFrame) -> DataFrame:
    """normalize_responses with empty: at most two characters of text and reasoning, and no tool call."""
    rows = normalize_responses(responses)
    said = F.length(F.concat(F.coalesce("text", F.lit("")), F.coalesce("reasoning", F.lit(""))))
    return rows.withColumn("empty", (said <= 2) & (F.size("tool_calls") == 0))


#: Where each dialect keeps a generation option. Those that a dialect lacks are left out of it.
OPTION_NAMES = {
    "openai_chat": {"max_tokens": "max_tokens", "temperature": "temperature", "top_p": "top_p", "stop": "stop"},
    "claude_chat": {"max_tokens": "max_tokens", "temperature": "temperature", "top_p": "top_p", "stop": "stop_sequences"},
    "openai_responses": {"max_tokens": "max_output_tokens", "temperature": "temperature", "top_p": "top_p"},
    "gemini_chat": {"max_tokens": "maxOutputTokens", "temperature": "temperature", "top_p": "topP", "stop": "stopSequences"},
}
OPTIONS = {"tool_choice": "string", "tool_name": "string", "max_tokens": "bigint", "temperature": "double", "top_p": "double", "stop": "array<string>"}


def json_text(s: Column) -> Column:
    """A string as a JSON string; null stays null."""
    return F.when(s.isNotNull(), F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2))


def json_object(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of name and JSON value; null values are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), c) for k, c in pairs]), F.lit("}"))


def object_schema(schema: Column) -> Column:
    """A tool's JSON schema as one of an object: with type object, properties, and required only if it is a list."""
    v = F.try_parse_json(schema)
    fine = either(string_of(v, "$.type") == "object") & either(is_kind(at(v, "$.properties"), "OBJECT")) & (~has(v, "$.required") | either(is_kind(at(v, "$.required"), "ARRAY")))
    part = lambda path, kind: F.when(is_kind(at(v, path), kind), F.to_json(at(v, path)))
    rebuilt = json_object(("type", F.lit('"object"')), ("description", part("$.description", "STRING")), ("properties", F.coalesce(part("$.properties", "OBJECT"), F.lit("{}"))), ("required", part("$.required", "ARRAY")))
    return F.when(fine, schema).otherwise(rebuilt)


def request_settings(target: str, tools: Column, option: dict[str, Column]) -> list[tuple[str, Column]]:
    """The target's JSON fields for tools (array of name, description, input_schema; null: none), tool choice and options."""
    listed = lambda each: F.when(F.size(tools) > 0, F.concat(F.lit("["), F.array_join(F.transform(tools, each), ","), F.lit("]")))
    named = lambda t, schema: (("name", json_text(t["name"])), ("description", json_text(t.description)), (schema, object_schema(t.input_schema) if schema == "input_schema" else t.input_schema))
    kind = lambda k: F.lit(f'"{k}"')
    choice, one = option["tool_choice"], option["tool_name"]
    name = json_text(one)
    values = {"max_tokens": option["max_tokens"].cast("string"), "temperature": option["temperature"].cast("string"), "top_p": option["top_p"].cast("string"), "stop": F.when(F.size(option["stop"]) > 0, F.to_json(option["stop"]))}
    options = [(to, values[own]) for own, to in OPTION_NAMES[target].items()]
    if target == "openai_chat":
        given = listed(lambda t: json_object(("type", kind("function")), ("function", json_object(*named(t, "parameters")))))
        chosen = F.when(one.isNotNull(), json_object(("type", kind("function")), ("function", json_object(("name", name))))).otherwise(json_text(choice))
    elif target == "openai_responses":
        given = listed(lambda t: json_object(("type", kind("function")), *named(t, "parameters")))
        chosen = F.when(one.isNotNull(), json_object(("type", kind("function")), ("name", name))).otherwise(json_text(choice))
    elif target == "claude_chat":
        given = listed(lambda t: json_object(*named(t, "input_schema")))
        mode = F.when(choice == "required", "any").when(choice == "none", "auto").otherwise(choice)
        chosen = F.when(one.isNotNull(), json_object(("type", kind("tool")), ("name", name))).when(mode.isNotNull(), json_object(("type", json_text(mode))))
    else:
        declared = listed(lambda t: json_object(*named(t, "parameters")))
        given = F.when(declared.isNotNull(), F.concat(F.lit("["), json_object(("functionDeclarations", declared)), F.lit("]")))
        mode = F.when(one.isNotNull() | (choice == "required"), "ANY").when(choice.isNotNull(), F.upper(choice))
        config = json_object(("mode", json_text(mode)), ("allowedFunctionNames", F.concat(F.lit("["), name, F.lit("]"))))
        chosen = F.when(mode.isNotNull(), json_object(("functionCallingConfig", config)))
        some = F.coalesce(*[c for _, c in options]).isNotNull()
        return [("tools", given), ("toolConfig", chosen), ("generationConfig", F.when(some, json_object(*options)))]
    return [("tools", given), ("tool_choice", chosen), *options]


def chat_export(blocks: DataFrame, target: str, model: str = "model", tools: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """request_id, path, body: one JSON body of the target dialect for each request of blocks.

    tools: explode_tools()' rows. options: request_id and any of OPTIONS, one row a request (tool_choice: auto, required or
    none; tool_name: the one tool to call). A request's blocks meet once, by request_id, and are put in order there.
    """
    fields = ["msg_seq", "block_seq", "role", "kind", "text", "call_id", "name", "payload", "url"]
    filled = blocks
    for f in fields[4:]:
        filled = filled.withColumn(f, F.coalesce(F.col(f), F.lit("")) if f in filled.columns else F.lit(""))
    by_message = filled.groupBy("request_id", "msg_seq").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct(*fields[1:]))).alias("b"))
    of = lambda b, kind: F.filter(b, lambda x: x.kind == kind)
    texts = lambda b: F.transform(of(b, "text"), lambda x: x.text)
    quoted, obj = json_text, json_object
    arr = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    b, role, system = F.col("b"), F.col("role"), F.col("role") == "system"
    plain = quoted(F.array_join(texts(b), "\n"))
    text_part = lambda x, t: obj(("type", F.lit(f'"{t}"')), ("text", quoted(x.text)))
    if target == "openai_chat":
        parts = F.transform(F.filter(b, lambda x: x.kind.isin("text", "image")), lambda x: F.when(x.kind == "image", obj(("type", F.lit('"image_url"')), ("image_url", obj(("url", quoted(x.url)))))).otherwise(text_part(x, "text")))
        content = F.when(F.size(of(b, "image")) > 0, arr(parts)).otherwise(plain)
        calls = F.transform(of(b, "tool_call"), lambda x: obj(("id", quoted(x.call_id)), ("type", F.lit('"function"')), ("function", obj(("name", quoted(x["name"])), ("arguments", quoted(x.payload))))))
        own = F.when(F.size(calls) > 0, obj(("role", quoted(role)), ("content", content), ("tool_calls", arr(calls)))).otherwise(obj(("role", quoted(role)), ("content", content)))
        results = F.transform(of(b, "tool_result"), lambda x: obj(("role", F.lit('"tool"')), ("tool_call_id", quoted(x.call_id)), ("content", F.coalesce(F.when(x.payload.startswith('"'), x.payload), quoted(x.payload)))))
        has_own = F.exists(b, lambda x: x.kind != "tool_result")
        items = F.concat(F.when(has_own, F.array(own)).otherwise(F.array().cast("array<string>")), results)
    elif target == "claude_chat":
        parts = F.filter(F.transform(b, lambda x: F.when(x.kind == "text", text_part(x, "text")).when(x.kind == "tool_call", obj(("type", F.lit('"tool_use"')), ("id", quoted(x.call_id)), ("name", quoted(x["name"])), ("input", x.payload))).when(x.kind == "tool_result", obj(("type", F.lit('"tool_result"')), ("tool_use_id", quoted(x.call_id)), ("content", x.payload)))), lambda p: p.isNotNull())
        items = F.array(obj(("role", F.when(role == "assistant", F.lit('"assistant"')).otherwise(F.lit('"user"'))), ("content", F.when(F.size(F.filter(b, lambda x: x.kind != "text")) == 0, plain).otherwise(arr(parts)))))
    elif target == "openai_responses":
        kind = F.when(role == "assistant", "output_text").otherwise("input_text")
        said = arr(F.transform(of(b, "text"), lambda x: obj(("type", quoted(kind)), ("text", quoted(x.text)))))
        own = F.array(obj(("type", F.lit('"message"')), ("role", quoted(role)), ("content", said)))
        calls = F.transform(of(b, "tool_call"), lambda x: obj(("type", F.lit('"function_call"')), ("call_id", quoted(x.call_id)), ("name", quoted(x["name"])), ("arguments", quoted(x.payload))))
        results = F.transform(of(b, "tool_result"), lambda x: obj(("type", F.lit('"function_call_output"')), ("call_id", quoted(x.call_id)), ("output", x.payload)))
        items = F.concat(F.when(F.size(of(b, "text")) > 0, own).otherwise(F.array().cast("array<string>")), calls, results)
    elif target == "gemini_chat":
        parts = F.filter(F.transform(b, lambda x: F.when((x.kind == "text") & (x.text != ""), obj(("text", quoted(x.text)))).when(x.kind == "tool_call", obj(("functionCall", obj(("name", quoted(x["name"])), ("args", x.payload))))).when(x.kind == "tool_result", obj(("functionResponse", obj(("name", quoted(F.when(x["name"] != "", x["name"]).otherwise(x.call_id))), ("response", obj(("result", x.payload)))))))), lambda p: p.isNotNull())
        items = F.when(F.size(parts) > 0, F.array(obj(("role", F.when(role == "assistant", F.lit('"model"')).otherwise(F.lit('"user"'))), ("parts", arr(parts))))).otherwise(F.array().cast("array<string>"))
    else:
        raise ValueError(f"unknown dialect {target}")
    if target != "openai_chat":
        items = F.when(system, F.array().cast("array<string>")).otherwise(items)
    one = by_message.select("request_id", F.struct("msg_seq", items.alias("items"), F.when(system, F.array_join(F.filter(texts(b), lambda t: t != ""), "\n")).alias("told")).alias("m"))
    whole = one.groupBy("request_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    listed = arr(F.flatten(F.transform("m", lambda m: m["items"])))
    told = F.filter(F.transform("m", lambda m: m["told"]), lambda t: t.isNotNull() & (t != ""))
    glue = "\n\n" if target == "openai_responses" else "\n"
    head = quoted(F.array_join(told, glue))
    some = F.size(told) > 0
    name = ("model", F.lit(f'"{model}"'))
    tooled = whole.withColumn("tools", F.lit(None).cast("array<struct<seq:int,name:string,description:string,input_schema:string>>"))
    if tools is not None:
        held = tools.groupBy(F.col("request_id").alias("asked")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", "description", "input_schema"))).alias("tools"))
        tooled = whole.join(held, F.col("request_id") == F.col("asked"), "left")
    if options is not None:
        own = options.select(F.col("request_id").alias("set_for"), F.struct(*[(F.col(c) if c in options.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONS.items()]).alias("o"))
        tooled = tooled.join(own, F.col("request_id") == F.col("set_for"), "left")
    option = {c: F.col(f"o.{c}") if options is not None else F.lit(None).cast(t) for c, t in OPTIONS.items()}
    more = request_settings(target, F.col("tools"), option)
    if target == "openai_chat":
        body, path = obj(name, ("messages", listed), *more), "/v1/chat/completions"
    elif target == "claude_chat":
        body, path = obj(name, ("system", F.when(some, head)), ("messages", listed), *more), "/v1/messages"
    elif target == "openai_responses":
        inputs = F.when(listed == "[]", F.lit('""')).otherwise(listed)
        body, path = obj(name, ("instructions", F.when(some, head)), ("input", inputs), *more), "/v1/responses"
    else:
        instruction = obj(("parts", F.concat(F.lit("["), obj(("text", head)), F.lit("]"))))
        body, path = obj(("systemInstruction", F.when(some, instruction)), ("contents", listed), *more), f"/v1beta/models/{model}:generateContent"
    return tooled.select("request_id", F.lit(path).alias("path"), body.alias("body"))
