import datetime
import unicodedata

from helpers import rows
from pyspark.sql import functions as F

from collabnet.functions import arrays as ar
from collabnet.functions import claims, dates, text, urls


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first()[0]


def test_arrays(spark):
    a = "a array<string>, b array<string>"
    c = F.col
    assert one(spark, ar.or_empty(c("a")), a, None, None) == []
    assert one(spark, ar.empty_to_null(c("a")), a, [], None) is None
    assert one(spark, ar.empty_to_null(c("a")), a, ["x"], None) == ["x"]
    assert one(spark, ar.drop_nulls(c("a")), a, ["x", None], None) == ["x"]
    assert one(spark, ar.drop_nulls(c("a")), a, None, None) == []
    assert one(spark, ar.concat_distinct(c("a"), c("b")), a, ["x", None, "y"], ["y", "z"]) == ["x", "y", "z"]
    assert one(spark, ar.concat_distinct(c("a"), c("b")), a, None, ["y"]) == ["y"]
    assert one(spark, ar.flatten_distinct(c("a")), "a array<array<string>>", [["x"], None, ["x", "y"]]) == ["x", "y"]
    assert one(spark, ar.lower_distinct(c("a")), a, ["X", "x"], None) == ["x"]
    assert one(spark, ar.head(c("a")), a, [], None) is None
    assert one(spark, ar.head(c("a")), a, ["p", "q"], None) == "p"
    assert one(spark, ar.tail(c("a")), a, ["p", "q"], None) == ["q"]
    assert one(spark, ar.tail(c("a")), a, ["p"], None) is None
    assert one(spark, ar.longer(c("a"), c("b")), a, ["x"], None) == ["x"]
    assert one(spark, ar.longer(c("a"), c("b")), a, None, []) == []
    assert one(spark, ar.longer(c("a"), c("b")), a, ["x"], ["y"]) == ["y"]
    assert one(spark, ar.blank_to_null(F.lit("")), a, None, None) is None
    assert one(spark, ar.as_list(F.lit(None).cast("string")), a, None, None) == []
    assert one(spark, ar.as_list(F.lit("x")), a, None, None) == ["x"]


def test_roles_and_sums(spark):
    assert one(spark, ar.split_roles(F.col("r")), "r string", " Bass, ,Drums [x] ") == ["Bass", "Drums [x]"]
    assert one(spark, ar.split_roles(F.col("r")), "r string", None) == []
    n = "n array<bigint>"
    assert one(spark, ar.sum_or_one(F.col("n")), n, [2, None, 3]) == 5
    assert one(spark, ar.sum_or_one(F.col("n")), n, [None]) == 1


def test_text(spark):
    s = "s string"
    assert one(spark, text.strip_accents(F.col("s")), s, "Bjørn é Ñandú") == "Bjrn e Nandu"
    assert one(spark, text.strip_accents(F.col("s")), s, None) is None
    assert one(spark, text.search_form(F.col("s")), s, "É. O'Neil-Smith (2)") == "e oneilsmith 2"
    assert one(spark, text.file_form(F.col("s")), s, "  José  María ") == "Jose_Maria"
    assert one(spark, text.display_name(F.col("s")), s, "John Smith (12)") == "John Smith"
    assert one(spark, text.spaced(F.col("s")), s, "Miles_Davis") == "Miles Davis"
    assert one(spark, text.html_escape(F.col("s")), s, 'a & "b" <c>') == "a &amp; &quot;b&quot; &lt;c&gt;"
    assert one(spark, text.escaped_name(F.col("s")), s, " A　& ") == "a&amp;"
    for bad in ["a.b", "a/b", "a\\b", "a'b", "x_y", "q?"]:
        assert one(spark, text.has_special_characters(F.col("s")), s, bad)
    for good in ["Miles Davis", "José (2)", "A-B"]:
        assert not one(spark, text.has_special_characters(F.col("s")), s, good)


def test_url_basics(spark):
    s = "s string"
    c = F.col("s")
    assert one(spark, urls.profile_url(urls.MB_PROFILE, c), s, "x") == urls.MB_PROFILE + "x"
    assert one(spark, urls.profile_url(urls.MB_PROFILE, c), s, None) is None
    assert one(spark, urls.primary_url(F.lit(7), c), s, " Miles  Davis ") == urls.PRIMARY_PROFILE + "7-Miles-Davis"
    assert one(spark, urls.lenient_id(c), s, "123") == 123
    assert one(spark, urls.lenient_id(c), s, "https://www.discogs.com/artist/123-Some-Name") == 123
    assert one(spark, urls.lenient_id(c), s, "abc") is None
    assert one(spark, urls.lenient_id(c), s, None) is None
    assert one(spark, urls.media_page_url(c), s, "A b.jpg") == urls.COMMONS_FILE + "A_b.jpg"
    assert one(spark, urls.media_hash_url(c), s, "a.jpg") == urls.COMMONS_UPLOAD + "/2/2e/a.jpg".replace(
        "2/2e", _digest_folders("a.jpg")
    )
    assert one(spark, urls.image_file(F.lit(5)), s, "") == "5.jpg"


def _digest_folders(name):
    import hashlib

    digest = hashlib.md5(name.encode()).hexdigest()
    return f"{digest[0]}/{digest[:2]}"


def test_url_lists(spark):
    u = "u array<string>"
    c = F.col("u")
    listed = [urls.KB_PROFILE + "Q1", "http://x.org/", urls.PRIMARY_PROFILE + "9", urls.PRIMARY_PROFILE + "8"]
    first = urls.first_with(c, urls.PRIMARY_PROFILE)
    assert one(spark, urls.last_segment(first), u, listed) == "9"
    assert one(spark, first, u, []) is None
    assert one(spark, urls.without(c, [urls.KB_PROFILE, urls.PRIMARY_PROFILE]), u, listed) == ["http://x.org/"]
    wiki = ["https://commons.wikipedia.org/x", "https://de.wikipedia.org/x", "https://en.wikipedia.org/x"]
    assert one(spark, urls.best_encyclopedia_url(c), u, wiki) == wiki[2]
    assert one(spark, urls.best_encyclopedia_url(c), u, wiki[:2]) == wiki[1]
    assert one(spark, urls.best_encyclopedia_url(c), u, wiki + ["https://es.wikipedia.org/y"]).startswith("https://es")
    assert one(spark, urls.best_encyclopedia_url(c), u, wiki[:1]) is None
    hosts = ["http://imdb.com/a", "http://www.imdb.com/long/b", "http://www.IMDB.com/bb/", "http://notimdb.com/"]
    assert one(spark, urls.best_host_url(c, "imdb.com"), u, hosts) == "http://www.IMDB.com/bb/"
    assert one(spark, urls.best_host_url(c, "imdb.com"), u, hosts[:1]) == hosts[0]


def test_home_page(spark):
    u = "n string, u array<string>"

    def guess(name, *found):
        return one(spark, urls.home_page(F.col("n"), F.col("u")), u, name, list(found))

    assert guess("Miles Davis", "http://davis.com", "http://www.milesdavis.com/x") == "http://www.milesdavis.com/x"
    assert guess("Miles Davis", "http://miles.com", "http://davis-site.com/a") == "http://davis-site.com/a"
    assert guess("Miles Davis", "http://miles.com") == "http://miles.com"
    assert guess("Miles Davis", "http://milesdavis.org", "http://facebook.com/milesdavis") is None
    assert guess("Miles Davis(2)", "http://milesdavis.com") == "http://milesdavis.com"
    assert guess("", "http://a.com") is None


def test_dates(spark):
    d = "d array<struct<time:string,calendar:string>>"
    c = F.col("d")
    greg, other = dates.GREGORIAN, "Q1985786"
    both = [("+1950-01-01T00:00:00Z", greg), ("+1961-10-20T00:00:00Z", greg), ("+1900-01-01T00:00:00Z", other)]
    assert one(spark, dates.parse_time(dates.birth_time(c)), d, both) == datetime.date(1961, 10, 20)
    assert one(spark, dates.birth_year(c), d, both) == 1961
    assert one(spark, dates.birth_year(c), d, [("+1961-00-00T00:00:00Z", greg)]) is None
    assert one(spark, dates.birth_year(c), d, [("+1961-10-20T00:00:00Z", other)]) is None
    assert one(spark, dates.birth_year(c), d, None) is None


def test_claims_of_odd_entities(spark):
    lines = [
        '{"id":"Q1","labels":{"en":{"value":"a \\"b\\""}},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}],'
        '"P434":[{"mainsnak":{"snaktype":"novalue"}},{"mainsnak":{"datavalue":{"value":"[x],y"}}}],'
        '"P569":[{"mainsnak":{"datavalue":{"value":{"time":"t","calendarmodel":"http://w/Q1"}}}}]},'
        '"sitelinks":{"a":{"site":"enwiki","title":"A b"},"b":{"site":"enwikiquote","title":"no"}}}',
        '{"id":"Q2","labels":[],"claims":[],"sitelinks":[]}',
        '{"id":"Q3","claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}},'
        '{"mainsnak":{"datavalue":{"value":{"id":"Q6"}}}}],"P106":[]}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "v string").select(
        F.from_json("v", claims.ENTITY_SCHEMA).alias("e")
    )
    got = rows(
        df, "e.id", claims.english("e", "labels"), claims.first_text("e", "P434"), claims.is_human("e"),
        claims.is_in_music("e"), claims.site_links("e"),
    )
    assert got == [
        ("Q1", "a b", "x", True, True, ["https://en.wikipedia.org/wiki/A_b"]),
        ("Q2", "", None, False, False, []),
        ("Q3", "", None, False, True, []),
    ]
    births = df.select(claims.birth_dates("e").alias("b")).first().b
    assert [(x.time, x.calendar) for x in births] == [("t", "Q1")]


def test_accents_of_every_character(spark):
    """The table of letters against decomposition, for all characters outside the surrogates."""
    points = [chr(p) for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(points[at : at + 500]) for at in range(0, len(points), 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = dict(df.select("i", text.strip_accents(F.col("s"))).collect())
    assert got == {i: unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode() for i, t in enumerate(texts)}
