from pyspark.sql import functions as F

from modq.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("x")).first()["x"]


def test_spaces_keep_unicode_rules(spark):
    assert one(spark, "a　 b\x1cc ", T.normalize_spaces) == "a b\x1cc "
    assert one(spark, "a\r\nb", T.clean_newlines) == "a  b"
    assert one(spark, "ÀB", T.ascii_lower) == "Àb"


def test_grams(spark):
    assert one(spark, "abc", lambda t: T.char_ngrams(t, 2, 4)) == ["ab", "bc", "abc"]
    assert one(spark, "a", lambda t: T.char_ngrams(t, 2, 4)) == []
    assert one(spark, " a  b c", lambda t: T.word_ngrams(t, 2, 2)) == ["a b", "b c"]
    assert one(spark, "A b", lambda t: T.ws_tokens(t, split=False)) == ["a b"]


def test_murmur_values():
    known = {"": 0, "a": 1009084850, "ab": -1681926305, "abc": -1277324294, "abcd": 1139631978, "hello": 613153351, "hello, world": 345750399, "中文": -618237545}
    assert list(T.murmur3_32([k.encode() for k in known])) == list(known.values())


def test_hash_bucket(spark):
    df = spark.createDataFrame([("ab",), ("hello",)], "g string").select("g", T.hash_bucket(F.col("g"), 1 << 20).alias("b")).select("g", "b.*")
    assert sorted(map(tuple, df.collect())) == [("ab", 10401, -1), ("hello", 784967, 1)]


def test_truncate_and_prompt(spark):
    assert one(spark, "0123456789", lambda t: T.truncate_middle(t, 6)) == "0123\n...[中间省略]...\n89"
    assert one(spark, "a<b & 'c'", lambda t: T.render_prompt(F.lit("X {{text}}"), t)) == "X a&lt;b &amp; &#x27;c&#x27;"


def test_estimate_tokens(spark):
    assert [one(spark, t, T.estimate_tokens) for t in ("eight words make up this quite short line", "hm", "山川草木", "  ")] == [15, 5, 10, None]


def test_parse_verdict(spark):
    v = one(spark, 'ok {"violation": true, "category": "x"} end', T.parse_verdict)
    assert (v.violation, v.category, v.reason, v.confidence, v.parse_error) == (True, "x", None, None, None)
    v = one(spark, '{"violation": "yes", "category": 1}', T.parse_verdict)
    assert (v.violation, v.category, v.parse_error) == (False, None, None)
    assert one(spark, "no json here", T.parse_verdict).parse_error


def test_created_at_is_strict(spark):
    assert str(one(spark, " 2024-01-31 10:00:00 ", T.parse_created_at)) == "2024-01-31 10:00:00"
    assert one(spark, "2024-01-31", T.parse_created_at) is None
    assert [one(spark, c, T.category_class) for c in (None, " Unknown ", "spam")] == ["missing", "unknown", "other"]


def test_json_is_whole(spark):
    """Nothing but white space may follow a value."""
    good = ['{"a": [1, "]"]}', " [1] \n", '"x"', "0", "null", '"a\\"],"']
    bad = ["", "{}]", "{} {}", "1,2", "[1],[2", "{", "nul", '{"a":1},', '1,"x"],', None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", T.json_of(F.col("t")).isNotNull().alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True] * len(good) + [False] * len(bad)
