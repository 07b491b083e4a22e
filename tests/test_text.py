import pytest
from pyspark.sql import functions as F

from pairloom import functions as fn
from pairloom.functions.text import BLANKS
from pairloom.operators import apply_chat_template, with_key

TEMPLATE = fn.ChatTemplate("<s>", "[", "] ", "\n", "[assistant] ")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize("answer, rank", [
    ("0", 0), ("ok 1\n", 1), (" 0 ", 0), ("", -1), ("abc", -1), ("1.", -1), (None, -1),
    ("first line 0\nthen 1\t\n", 1), ("1 ", 1), ("0\n\nno", -1), ("10", 0), ("١", -1),
    ("1\x1f\u3000\xa0", 1), ("0\u200b", -1), ("\U0001f600", -1), (" \n", -1),
])
def test_verdict_is_the_last_visible_character(spark, answer, rank):
    assert one(spark, answer, fn.parse_verdict("text")) == rank
    if answer and answer.strip():
        assert rank == (int(answer.strip()[-1]) if answer.strip()[-1] in ("0", "1") else -1)


def test_blanks_are_those_that_strip_removes():
    assert sorted(BLANKS) == [chr(c) for c in range(0x110000) if not chr(c).strip()]


@pytest.mark.parametrize("text, key", [
    ("SUBREDDIT: r/tifu\nTITLE", "tifu"), ("SUBREDDIT:r/a_b1-c", "a_b1"),
    ("SUBREDDIT: r/é1 x", "é1"), ("no header", None), ("x\nSUBREDDIT: r/tifu", None),
    ("", None), (None, None),
])
def test_key_is_taken_from_the_first_line(spark, text, key):
    assert one(spark, text, fn.extract_key("text", on_missing="null")) == key


def test_text_without_a_key_fails_or_is_dropped(spark):
    posts = spark.createDataFrame([("SUBREDDIT: r/a",), ("none",)], "text string")
    assert [row.key for row in with_key(posts, "text", on_missing="drop").collect()] == ["a"]
    with pytest.raises(Exception, match="no key found"):
        with_key(posts, "text").collect()
    with pytest.raises(ValueError):
        with_key(posts, "text", on_missing="skip")


def test_template_slots_equal_str_format(spark):
    template = "{{t}}: {text}|{response0}|{response1}|{{{text}}}"
    rows = [("plain", "a", "b"), ("{response0} {{", "{text}", "}"), ("", "$1", "\\1")]
    table = spark.createDataFrame(rows, "text string, response0 string, response1 string")
    filled = fn.render_template(template, text="text", response0="response0", response1="response1")
    assert [row[0] for row in table.select(filled).collect()] == [
        template.format(text=t, response0=a, response1=b) for t, a, b in rows
    ]


def test_template_errors(spark):
    with pytest.raises(ValueError):
        fn.render_template("{text} {other}", text="text")
    with pytest.raises(Exception, match="null input"):
        one(spark, None, fn.render_template("<{text}>", text="text"))
    assert one(spark, None, fn.render_template("<{text}>", "propagate", text="text")) is None
    assert one(spark, "x", fn.render_template("{{no slot}}")) == "{no slot}"


def test_path_label(spark):
    for path in ("lab/model", "lab/model/x", "a//b"):
        assert one(spark, path, fn.path_label("text")) == fn.path_label_of(path)


def test_messages(spark):
    plain = one(spark, "hi", fn.to_messages("text"))
    assert [tuple(m) for m in plain] == [("user", "hi")]
    both = one(spark, "hi", fn.to_messages("text", "short"))
    assert [tuple(m) for m in both] == [("system", "short"), ("user", "hi")]


def test_plain_chat_template(spark):
    table = spark.createDataFrame([("hi", "ho")], "a string, b string")
    written = apply_chat_template(
        table, ["a", "b"], TEMPLATE, add_generation_prompt=True, system_prompt="s"
    ).first()
    assert written.a == "<s>[system] s\n[user] hi\n[assistant] "
    assert written.b == "<s>[system] s\n[user] ho\n[assistant] "
    beside = apply_chat_template(table, ["a"], TEMPLATE, new_columns=["c"]).first()
    assert (beside.a, beside.c) == ("hi", "<s>[user] hi\n")


def test_conversational_chat_template_ignores_the_system_prompt(spark):
    schema = "chat array<struct<role string, content string>>"
    table = spark.createDataFrame([([("user", "q"), ("assistant", "")],), ([],)], schema)
    written = apply_chat_template(table, ["chat"], TEMPLATE, "conversational", system_prompt="s")
    assert [row.chat for row in written.collect()] == ["<s>[user] q\n[assistant] \n", "<s>"]


@pytest.mark.parametrize("chat", [None, [("user", None)], [(None, "x"), ("user", "y")]])
def test_a_null_turn_is_not_lost_in_silence(spark, chat):
    schema = "chat array<struct<role string, content string>>"
    table = spark.createDataFrame([(chat,)], schema)
    kept = apply_chat_template(table, ["chat"], TEMPLATE, "conversational", on_null="propagate")
    assert kept.first().chat is None
    with pytest.raises(Exception, match="null message"):
        apply_chat_template(table, ["chat"], TEMPLATE, "conversational").collect()


def test_hash_bounds():
    for fraction in (0, 1, 1.5, -0.1):
        with pytest.raises(ValueError):
            fn.below_fraction(F.lit("x"), fraction, 0)
