import unicodedata

from pyspark.sql import functions as F

from listwright.functions import phones as P
from listwright.functions import text as X
from listwright.functions import urls as U


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "s string").select(expression(F.col("s")).alias("x")).first().x


def test_fold_equals_decomposition_for_every_character(spark):
    text = "".join(chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    wanted = "".join(c for c in unicodedata.normalize("NFKD", text) if ord(c) < 0x80)
    assert value(spark, text, X.ascii_fold) == wanted


def test_fold_keeps_order_and_ascii(spark):
    assert value(spark, "Café ½ ﬁn L’Œuf", X.ascii_fold) == "Cafe 12 fin Luf"
    assert value(spark, None, X.ascii_fold) is None


def test_clean_name(spark):
    assert value(spark, "\t B&M Restaurant \r", X.clean_name) == "BandM Restaurant"


def test_tokens(spark):
    assert value(spark, "Le Café:  The THE Bar", X.name_tokens) == ["cafe", "bar"]
    assert value(spark, "Au Le De", X.name_tokens) == []


def test_lines(spark):
    assert value(spark, "a\r\n\rb\n\n", X.split_lines) == ["a", "", "b", ""]
    assert value(spark, "a", X.split_lines) == ["a"]
    assert value(spark, "", X.split_lines) == []


def test_lookup_keys(spark):
    search = value(spark, "Café Zoë", lambda s: X.lookup_key(s, "search"))
    assert search == "https://www.google.ca/search?q=cafe+zoe+montreal"
    profile = value(spark, "Café Zoë", lambda s: X.lookup_key(s, "profile"))
    assert profile == "https://twitter.com/search?q=Cafe%20Zoe%20montreal&mode=users"


def test_percent_decode(spark):
    assert value(spark, "a+b%20c%zz 100% %C3%AA", U.percent_decode) == "a+b c%zz 100% ê"


def test_redirects(spark):
    assert value(spark, "/url?q=http://a.test/?x=1&sa=U", U.unwrap_redirect) == "http://a.test/?x=1"
    assert value(spark, "/plain", U.unwrap_redirect) == ""
    assert value(spark, "/r?url=http%3A%2F%2Fa.test%2F&src=1", U.unquote_redirect) == "http://a.test/"


def test_very_long_links(spark):
    long = "data:" + "x" * 200_000
    assert value(spark, long, U.unwrap_redirect) == ""
    assert value(spark, long + "=y", U.unwrap_redirect) == "y"
    assert value(spark, long, U.strip_www) == long


def test_hosts(spark):
    assert value(spark, "/url?q=http://www.yelp.com/biz", U.is_denied) is True
    assert value(spark, "/url?q=http://yelper.com/biz", U.is_denied) is False
    assert value(spark, "/search?q=x", U.has_host) is False


def test_root_urls(spark):
    cases = {"http://a.test": True, "https://a.test//": True, "http://a.test/x": False, "ftp://a.test": False}
    for url, root in cases.items():
        assert value(spark, url, U.is_root_url) is root


def test_strip_www(spark):
    assert value(spark, "http://www.a.test/www.b", U.strip_www) == "a.test/www.b"
    assert value(spark, "http://a.test", U.strip_www) == "a.test"
    assert value(spark, None, U.strip_www) is None


def test_phones(spark):
    accepted = {"(514) 273-7442": True, "514-273-7442": True, "5142737442": True, "(114) 273-7442": False,
                "514.273.7442": False, "call 514-273-7442": False}
    for text, strict in accepted.items():
        assert value(spark, text, P.is_strict_phone) is strict
    assert value(spark, "x (514) 273-7442 y", P.phone_loose) == "(514) 273-7442"
    assert value(spark, "none", P.phone_loose) is None
    assert value(spark, "(514) 273-7442", P.phone_format) == "514.273.7442"
    assert value(spark, "a 514 273-7442, 438.273.7443", P.phones_all) == [" 514 273-7442", " 438.273.7443"]
