import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as X


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("text, cap, want", [
    ("How does spark-sql-driver connect to Hive?", 0, ["spark-sql-driver", "spark", "sql", "driver", "connect", "hive"]),
    ("please the in a 12345 I", 0, []),
    ("worker worker port port worker", 0, ["worker", "port"]),
    ("north south east west", 2, ["north", "south"]),
    ("open src/main/save.py", 0, ["open", "src/main/save.py", "src", "main", "save", "py"]),
    ("about parquet.", 0, ["parquet"]), ("--a_b--", 0, ["a_b"]), ("", 0, []), ("İstanbul É x9", 0, ["istanbul", "x9"]), ("../../x.y 7.5", 0, ["x.y", "7.5"]),
])
def test_tokenize(spark, text, cap, want):
    assert one(spark, lambda c: X.tokenize(c, cap), text) == want


@pytest.mark.parametrize("text, want", [
    ("please fix the error in a file 12345 ok?", []), ("check the save code in src/graph/save.go", ["check", "save", "src/graph/save.go", "src", "graph", "go"]), ("thanks, now update that working file", []),
])
def test_chat_filler(spark, text, want):
    assert one(spark, X.tokenize, text) == want


def test_stopwords_of_another_language(spark, tmp_path):
    (tmp_path / "more.txt").write_text("und oder weil\nder die das\n")
    words = X.load_stopwords(spark, str(tmp_path / "more.txt"))
    assert one(spark, lambda c: X.tokenize(c, 0, words), "der Parser und die Tabelle, weil the das index") == ["parser", "tabelle", "index"]
    assert one(spark, lambda c: X.tokenize(c, 0, words), "derweil") == ["derweil"] and one(spark, lambda c: X.tokenize(c, 0), "der parser") == ["der", "parser"]


def test_middle_clips(spark):
    assert one(spark, lambda c: X.clip_middle(c, 9), "abcdefghijkl") == "abcdef\n…\njkl" and one(spark, lambda c: X.clip_middle(c, 12), "abcdefghijkl") == "abcdefghijkl"
    assert one(spark, lambda c: X.clip_middle(c, 9), "abcdeéfghiéjk") == "abcde\n…\néjk"
    assert len(one(spark, X.clip_message, "x" * 9000)) == 6003 and len(one(spark, X.clip_message, "Subagent report: " + "x" * 9000)) == 8003


def test_terms(spark):
    known, prompt = ["guard insert remisier", "two_words"], ["mine"]
    got = one(spark, lambda t, p, k: X.expansion_terms(t, p, k), ["Guard-Insert-Remisier", "two  words", "the", "MINE", "a{b", "x", "dup", "dup", "un-known"], prompt, known)
    assert got == ["guard-insert-remisier", "guard insert remisier", "two words", "two_words", "dup", "un-known"]


def test_terms_of_the_prompt_with_odd_white_space(spark):
    assert one(spark, lambda t, p: X.expansion_terms(t, p, F.array().cast("array<string>")), ["or.\u00a0Es", "kept"], ["or.\u00a0es"]) == ["kept"]


def test_sizes_in_the_middle_go_to_the_even_digit(spark):
    assert [one(spark, X.human_bytes, n) for n in (1536, 2560, 3584, 2561, 1310720, 1835008)] == ["2KB", "2KB", "4KB", "3KB", "1.2MB", "1.8MB"]
    assert spark.sql("select cast(null as long) n").select(X.human_bytes(F.col("n"))).first()[0] is None


def test_escapes_sizes_replies(spark):
    assert one(spark, X.escape_control, "a\tb\x7fc") == "a\\u0009b\\u007Fc" and one(spark, X.escape_control, "plain") == "plain"
    assert [one(spark, X.human_bytes, n) for n in (5, 2048, 3 << 20)] == ["5B", "2KB", "3.0MB"]
    assert one(spark, X.same_reply, "a  b\nc", "a b c") and not one(spark, X.same_reply, "a b", "a c") and one(spark, X.same_reply, "zzz", " ")


def test_own_stopwords(spark):
    assert one(spark, lambda c: X.tokenize(c, 0, ["yang", "dan"]), "yang akun dan dana the") == ["akun", "dana", "the"]


def test_hash_ignores_case_and_outer_space(spark):
    h = lambda s: one(spark, lambda c: X.content_hash(F.lit("p"), c), s)
    assert h("  Note x \n") == h("note X") != h("note y")


@pytest.mark.parametrize("seconds, want", [(0, "just now"), (89, "just now"), (90, "1m"), (5399, "89m"), (5400, "1h"), (129599, "35h"), (129600, "1d"), (1000000, "11d")])
def test_relative_age(spark, seconds, want):
    assert one(spark, lambda c: X.relative_age(c, F.lit(0)), seconds) == want


def test_clips(spark):
    assert one(spark, lambda c: X.clip_chars(c, 4), "aéb") == "aéb" and one(spark, lambda c: X.clip_chars(c, 2), "aéb") == "a" and one(spark, lambda c: X.clip_chars(c, 3), "aéb") == "aé"
    assert one(spark, lambda c: X.ellipsis(c, 6), "hello world") == "hello…" and one(spark, lambda c: X.ellipsis(c, 20), "hello") == "hello"


def test_lists(spark):
    assert one(spark, X.clean_aliases, ["  A  b ", "a b", "", "x" * 41, "C"]) == ["a b", "c"]
    assert one(spark, X.jaccard, ["a", "b"], ["b", "c"]) == pytest.approx(1 / 3) and one(spark, X.jaccard, [], ["a"]) == 0.0
    assert one(spark, X.basename, "a/b/c") == "c" and one(spark, X.basename, "a/b/") == "a/b/"
    assert one(spark, X.slice_json, "x ```json\n{\"a\": {}}\n``` y") == '{"a": {}}'
    assert one(spark, lambda a, b: X.idf(a, b), 2000, 1) == pytest.approx(7.195, abs=0.01) and one(spark, lambda a, b: X.idf(a, b), 2000, 500) == pytest.approx(1.386, abs=0.01)
    assert one(spark, X.command_prompt, "/deploy now") == "deploy now" and one(spark, X.command_prompt, "/usr/bin x") == "/usr/bin x"
