"""Addresses by street names: longest phrase, leftmost address, glued numbers, commas, texts without any."""

from listwright.operators import gazetteer as Z

KNOWN = ["1 Rue Saint-Denis, Montreal", "22 Boul Saint-Laurent E, QC", "9 Rue Saint-Denis Nord, X", "3 Av Café", "7 Place 12 Main", "no number street", "5", None]


def found(spark, *texts):
    known = Z.streets(spark.createDataFrame([(k,) for k in KNOWN], "address_raw string"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    return sorted((r["doc"], r["pos"], r["address"]) for r in Z.find_addresses(df, known, "doc").collect())


def test_streets(spark):
    known = Z.streets(spark.createDataFrame([(k,) for k in [*KNOWN, KNOWN[0]]], "address_raw string"))
    assert {(r["phrase"], r["words"], r["street"]) for r in known.collect()} == {
        ("rue saint-denis", 2, "Saint-Denis Street"),
        ("boulevard saint-laurent est", 3, "Saint-Laurent Boulevard East"),
        ("rue saint-denis nord", 3, "Saint-Denis Street North"),
        ("avenue cafe", 2, "Café Avenue"),
        ("place 12 main", 3, "Place 12 Main"),
    }


def test_addresses(spark):
    assert found(
        spark,
        "Meet at 1741, Rue Saint-Denis (corner) or 12A boulevard SAINT-LAURENT est!",
        "the 40 rue saint-denis nord and 41 Rue Saint-Denis, Nord",
        "call 514 555 1234, 6631Av café; 123456 Rue Saint-Denis",
        "at 7 place 12 main 12 Rue Saint-Denis",
        "8 Rue, Saint-Denis and 9 Rue Unknown",
        "",
        None,
        "no digits here",
        "ends in 5",
    ) == [
        (0, 2, "1741 Saint-Denis Street"),
        (0, 7, "12A Saint-Laurent Boulevard East"),
        (1, 1, "40 Saint-Denis Street North"),
        (1, 6, "41 Saint-Denis Street"),
        (2, 4, "6631 Café Avenue"),
        (3, 1, "7 Place 12 Main"),
        (3, 5, "12 Saint-Denis Street"),
    ]


def test_overlapping_addresses(spark):
    """The leftmost address wins over one that begins with a number inside it."""
    known = Z.streets(spark.createDataFrame([("1 Rue 12 Main",), ("2 Main",)], "address_raw string"))
    df = spark.createDataFrame([(1, "at 5 rue 12 main 3 main")], "doc long, text string")
    assert sorted(r["address"] for r in Z.find_addresses(df, known, "doc").collect()) == ["3 Main", "5 12 Main Street"]
    assert Z.find_addresses(df.limit(0), known, "doc").count() == 0 == Z.find_addresses(df, known.limit(0), "doc").count()
