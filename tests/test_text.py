import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.redact import redact, redact_all


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.clean_text, "  a\t\t b  \r\n c  \n", "a b\n c"),
        (T.clean_user_text, "<System-Reminder>x\ny</system-reminder>Hello   world", "Hello world"),
        (T.clean_user_text, "a <system-reminder> open", "a <system-reminder> open"),
        (lambda c: T.strip_tag(c, "<!--", "-->"), "<!<!-- a -->-- b -->c", "c"),
        (lambda c: T.strip_tag(c, "<!--", "-->"), "<!<!<!<!-- a -->-- b -->-- c -->-- d -->e", "e"),
        (lambda c: T.strip_tag(c, "<!--", "-->"), "<!<!-- a -->-- b <!-- c --> d -->", " d -->"),
        (T.normalize_timestamp, "2026-05-13T01:02:03.123456789Z", "2026-05-13T01:02:03.123456789+00:00"),
        (T.normalize_timestamp, "2026-05-13t01:02:03.123000-01:00", "2026-05-13T02:02:03.123+00:00"),
        (lambda c: T.truncate(c, 5), "ab  cd ef", "ab c..."),
        (lambda c: T.truncate(c, 5), " ab  cd ", "ab cd"),
        (T.clean_for_embedding, "keep <!-- hidden -->\n```\n" + "x\n" * 45 + "```", "keep \n[long output omitted]".replace(" \n[", "\n```[") + "```"),
        (T.clean_for_embedding, "x" * 510, "x" * 500 + " [truncated]"),
        (T.clean_for_embedding, "a\n\n\n\n\n\nb", "a\n\n\nb"),
        (T.drop_long_logs, "\n".join(map(str, range(130))), "\n".join([*map(str, range(80)), "[long output omitted]", *map(str, range(110, 130))])),
        (T.title, "", "Conversation"),
        (T.title, "How do I run this?\nrest", "How do I run this?"),
        (T.title, "y" * 90, "y" * 79 + "..."),
        (T.token_count, "", 0),
        (T.token_count, "  ", 1),
        (T.token_count, "a b c", 3),
        (T.content_hash, "abc", "ba7816bf8f01cfea"),
        (T.decode_project, "-Users-alice-Projects-demo", "/Users/alice/Projects/demo"),
        (T.decode_project, "plain-name", "plain-name"),
        (T.normalize_timestamp, "2026-05-13T03:02:03+02:00", "2026-05-13T01:02:03+00:00"),
        (T.normalize_timestamp, "2026-05-13T01:02:03.250Z", "2026-05-13T01:02:03.250+00:00"),
        (T.normalize_timestamp, "yesterday", "yesterday"),
        (T.normalize_timestamp, None, None),
        (T.lines, "", []),
        (T.lines, "a\r\n\n", ["a", ""]),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


GH = "gh" + "p_" + "a1" * 16


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("openai " + "sk" + "-" + "abcdefghijklmnopqrstuvwxyz" + "012345", "openai <redacted>"),
        ('export API_KEY="abc def"\ntoken: ' + GH, 'export API_KEY="<redacted>"\ntoken: <redacted>'),
        ("client_secret='v1' PATH=/usr/bin", "client_secret='<redacted>' PATH=<redacted>"),
        ("aws_secret_access_key = wJalr", "aws_secret_access_key = <redacted>"),
        ("Authorization: " + "Bearer " + "abcdefgh1234", "Authorization: <redacted>"),
        ("a -----BEGIN RSA " + "PRIVATE KEY-----\nx\ny\n-----END RSA " + "PRIVATE KEY----- b", "a <redacted> b"),
        ("AK" + "IA" + "A" * 16, "<redacted>"),
        ("nothing here", "nothing here"),
        (None, None),
    ],
)
def test_redact(spark, given, wanted):
    once = one(spark, given, redact)
    assert once == wanted
    assert one(spark, once, redact) == once


def test_redact_home_and_long_chains(spark):
    assert one(spark, "/Users/alex/project/file", lambda c: redact(c, "/Users/alex")) == "~/project/file"
    long = "a_" * 20_000
    assert one(spark, long, redact) == long
    assert "hunter2" not in one(spark, "k_" * 100 + "password=hunter2", redact)
    # a long chain changes nothing for its neighbours: a key inside a word isn't one
    assert one(spark, "mytoken=keep " + "k_" * 80 + "token=gone a__token=keep -_token=keep x-token=gone", redact) == "mytoken=keep " + "k_" * 80 + "token=<redacted> a__token=keep -_token=keep x-token=<redacted>"


def test_redact_withholds_what_it_cannot_read(spark, monkeypatch):
    from threadloom.functions import redact as module

    monkeypatch.setattr(module, "TOKENS", (*module.TOKENS[:-1], "(broken"))
    assert one(spark, "anything", redact) == "<redacted>"
    assert one(spark, None, redact) is None


def test_redact_lists(spark):
    rows = spark.createDataFrame([(["token=abc", "x"],)], "t array<string>")
    assert rows.select(redact_all(F.col("t")).alias("t")).first()["t"] == ["token=<redacted>", "x"]


def test_timestamps_keep_utc(spark):
    now = datetime.datetime(2026, 1, 2, 3, 4, 5, tzinfo=datetime.UTC).isoformat()
    assert one(spark, now, T.normalize_timestamp) == now
