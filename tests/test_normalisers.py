"""Golden normalisation cases and properties."""

from pyspark.sql import functions as F

from linkloom.functions import line_a, line_b
from linkloom.functions.tokens import char_wb_grams, collapse_initials, dedupe_consecutive, fix_leet, joined, tokens, word_grams
from linkloom.functions.translit import to_ascii


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first()[0]


def test_token_rules(spark):
    t = tokens(F.col("a"))
    assert one(spark, joined(collapse_initials(t)), a="l l c acme p c") == "llc acme pc"
    assert one(spark, joined(fix_leet(t)), a="n0rth 5ons 77 a1 6ab") == "north sons 77 a1 6ab"
    assert one(spark, joined(dedupe_consecutive(t)), a="a a b a") == "a b a"
    assert one(spark, char_wb_grams(F.col("a")), a="ab c") == [" ab", "ab ", " c "]
    assert one(spark, word_grams(F.col("a")), a="x y z") == ["x", "y", "z", "x y", "y z"]
    assert one(spark, word_grams(F.col("a")), a="") == []


def clean_name(spark, raw):
    r = line_a.clean_name(spark.range(1).select(F.lit(raw).alias("n")), "n").first()
    return r.name_clean, r.name_core, r.name_alt, r.legal, r.name_is_domain


def test_names_line_a(spark):
    assert clean_name(spark, "Halotavo F/K/A Roach Beverage Corp") == ("halotavo roach beverage corp", "roach beverage", "halotavo", "corp", 0)
    assert clean_name(spark, "The L.L.C.")[3] == "llc"
    assert clean_name(spark, "www.indriya-club.com") == ("indriya club", "indriya club", "", "", 1)
    assert clean_name(spark, "Acme (ID: 77) | www.acme.com")[0] == "acme"
    assert clean_name(spark, "Raj & Sons Pvtltd")[0] == "raj and sons pvt ltd"
    assert clean_name(spark, "") == ("", "", "", "", 0)


def clean_address(spark, raw, country="us"):
    r = line_a.clean_address(spark.range(1).select(F.lit(raw).alias("a"), F.lit(country).alias("c")), "a", "c").first()
    return r.addr_clean, r.addr_nums, r.state, r.postcode


def test_addresses_line_a(spark):
    assert clean_address(spark, "2nd Floor, 12 Main St") == ("2 12 main street", "2 12", "", "")
    assert clean_address(spark, "0701 Main St, TX, 00272") == ("701 main street 272", "701 272", "texas", "272")
    assert clean_address(spark, "5 opp park, tn", "india")[2] == "tamil nadu"
    assert clean_address(spark, "5 rue x, tn", "france")[2] == "tn"
    assert clean_address(spark, "po box 44, 5 oak rd") == ("5 oak road", "5", "", "")
    assert clean_address(spark, "") == ("", "", "", "")


def test_phonetic(spark):
    same = [one(spark, line_a.phonetic(F.col("a")), a=a) for a in ("bright producer", "brait prodyusr")]
    assert same[0].split()[0] == same[1].split()[0]
    assert one(spark, line_a.phonetic(F.col("a")), a="12b main") == "12b n"


def test_line_b(spark):
    assert one(spark, F.array_join(line_b.name_words(F.col("a")), " "), a="www.indriyaclub.com") == "indriyaclub"
    assert one(spark, F.array_join(line_b.address_words(F.col("a")), " "), a="0701 new jersey st, null") == "701 nj street"
    assert one(spark, F.array_join(line_b.address_words(F.col("a")), " "), a="0083-231") == "83 231"
    assert one(spark, line_b.without_contacts(F.col("a")), a="P.O. Box 12 oak").split() == ["oak"]
    rows = line_b.prepared(spark.createDataFrame([("LLC", ""), ("Acme Group Inc", "Darby CITY")], "name string, addr string")).collect()
    assert [r.core_n for r in rows] == ["llc", "acme group"]
    assert [r.core_c for r in rows] == ["llc", "acme"] and rows[1].addr_c == "darby" and rows[1].legal == "inc"


def test_names_are_stable(spark):
    df = spark.createDataFrame([(x,) for x in ("Raj & Sons Ltd", "n0rth 5ons", "A B C Co", "x")], "n string")
    again = df.select(F.array_join(line_b.name_words(F.col("n")), " ").alias("n"))
    assert [r[0] for r in again.select(F.array_join(line_b.name_words(F.col("n")), " ")).collect()] == [r[0] for r in again.collect()]


def test_transliteration():
    assert to_ascii("Élan Ça ß") == "Elan Ca ss"
    assert to_ascii("plain") == "plain"
    assert to_ascii("श्री").isascii() and to_ascii("श्री").startswith("shr")


def test_fixed_width_and_ids(spark):
    row = spark.range(1).select(line_b.fixed_bytes(F.lit("abc"), 5).alias("b"), line_b.fixed_bytes(F.lit("abcdefg"), 4).alias("c"), line_b.id_num(F.lit("S2-0042")).alias("n")).first()
    assert bytes(row.b) == b"abc\0\0" and bytes(row.c) == b"abcd" and row.n == 42
