import random
import re

from helpers import rows
from pyspark.sql import functions as F

from collabnet.operators import credits as cr
from collabnet.operators.containment import contained, matching

C = "id_release bigint, id_artist bigint, master_id bigint"


def test_multi_party(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, None)], C)
    assert rows(cr.multi_party(df), "id_release", "id_artist", "cant_arts") == [(1, 1, 2), (1, 2, 2)]


def test_one_version_keeps_busy_artists_and_single_versions(spark):
    data = [(1, 1, 10), (2, 1, 10), (2, 2, 10), (3, 3, 11), (4, 4, None), (5, 5, None)]
    got = rows(cr.one_version(spark.createDataFrame(data, C)), "id_artist", "id_release", "cant_rels", "cant_vers")
    # artist 2: one release of a master with two versions; 4 and 5 share the group without master
    assert got == [(1, 1, 2, 2), (1, 2, 2, 2), (3, 3, 1, 1)]


def test_role_words(spark):
    df = spark.createDataFrame([(["Bass Guitar", "Recorder", "Producer", "Talk"],), ([],)], "r array<string>")
    got = [r[0] for r in df.select(cr.wanted_roles(F.col("r"), ["guitar", "recorder"])).collect()]
    assert got == [["Bass Guitar"], []]  # "recorder" is denied although allowed
    assert cr.any_word(["bass", "contrabass", "A&R"]) == r"a\&r|bass"


def test_merge_credits(spark):
    data = [
        (1, 5, "A", "Guitar, Producer"),
        (1, 5, "A2", "Drums"),
        (1, 5, "A", "Guitar"),
        (1, 6, "B", "Mixed By"),
        (1, None, "C", "Guitar"),
        (2, 5, "A", None),
    ]
    df = spark.createDataFrame(data, "id_release bigint, id bigint, name string, role string")
    assert rows(cr.merge_credits(df, "id_release", ["guitar", "drum"])) == [(1, 5, ["A", "A2"], ["Drums", "Guitar"])]


def test_solo_and_names(spark):
    data = [("x", []), ("x", ["x"]), ("x", ["y"]), ("x", ["x", "y"]), ("a.b", []), (None, [])]
    df = spark.createDataFrame(data, "name string, members_name array<string>")
    assert cr.solo_artists(df).count() == 4
    assert cr.plain_names(df).count() == 4


def test_version_collapse(spark):
    schema = C + ", formats array<string>, primary_artists array<bigint>"
    data = [
        (5, 1, 9, ["LP"], [1]),
        (3, 1, 9, ["CD"], [1]),
        (7, 2, None, ["LP"], None),
        (8, 3, 9, ["LP", "Compilation"], [1]),
        (9, 4, 9, None, [194]),
        (3, 5, 9, ["CD Sampler"], [2]),
    ]
    got = rows(cr.version_collapse(spark.createDataFrame(data, schema)), "id_artist", "master_id", "id_release")
    assert got == [(1, 9, 3), (2, -7, 7)]


def test_rollup_and_releases(spark):
    df = spark.createDataFrame(
        [(1, ["J", "R"], ["Bass"]), (1, ["J"], None), (2, None, None)],
        "id_artist bigint, genres array<string>, roles_artist array<string>",
    )
    assert rows(cr.artist_rollup(df)) == [(1, ["J", "R"], ["Bass"]), (2, [], [])]
    assert cr.releases(df.withColumn("id_release", F.lit(1)).drop("genres")).count() == 1


def test_instrument_words(spark):
    entities = spark.createDataFrame([(["Q1", "Q2"],), (["Q1"],)], "instrument_ids array<string>")
    labels = spark.createDataFrame([("Q1", "Piano"), ("Q2", ""), ("Q3", "House")], "id string, label string")
    assert rows(cr.instrument_words(entities, labels)) == [("piano",)]


def test_containment_against_plain_python(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(200)})
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))) for _ in range(60)} | {""})
    frame = lambda rows_, name: spark.createDataFrame([(x,) for x in rows_], f"{name} string")
    got = rows(contained(frame([*texts, None, texts[0]], "text"), frame([*words, None], "word")), "text", "word")
    assert got == sorted(((t, w) for t in texts for w in words if w in t), key=repr)
    assert contained(frame(texts, "text"), frame([], "word")).count() == contained(frame([], "text"), frame(words, "word")).count() == 0
    patterns = ["ab", "^a.*c$", "a[bc]a", "ab?c", "(ab|ca)c", "b+c", "a{2}", r"\\w b", "cc|bb", "x*", "", "^$"]
    got = rows(matching(frame(texts, "text"), frame(patterns, "term")), "text", "term")
    assert got == sorted(((t, p) for t in texts for p in patterns if re.search(p, t)), key=repr)
    got = rows(matching(frame(texts, "text"), frame(["a.", "ab", "b c"], "term"), literal=True), "text", "term")
    assert got == sorted(((t, p) for t in texts for p in ["a.", "ab", "b c"] if p in t), key=repr)


def test_role_words_as_tables(spark):
    listed = [(1, 5, "A", "Guitar, Guitar [Producer]"), (1, 5, "B", "Lead GUITAR"), (1, None, "C", "Guitar"), (2, 6, "D", "Mixed By"), (2, 7, "E", None)]
    df = spark.createDataFrame(listed, "id_release int, id int, name string, role string")
    words = spark.createDataFrame([("Guitar",), ("mixed",), (None,)], "word string")
    want = [(1, 5, ["A", "B"], ["Guitar", "Lead GUITAR"])]
    assert rows(cr.merge_credits(df, "id_release", words)) == rows(cr.merge_credits(df, "id_release", ["guitar", "mixed"])) == want
