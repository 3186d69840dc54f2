import pytest
from pyspark.sql import functions as F

from listwright.fixed_values import STREET_DIRECTIONS
from listwright.functions import addresses as A
from listwright.operators.addresses import standardise_addresses

STANDARD = {
    "1951 Avenue Du Mont-Royal Est, Montreal, QC H2H 1J5": "1951 Du Mont-Royal Avenue East",
    "3545 Swail Av, Montreal, QC H3T 1P5": "3545 Swail Avenue",
    "1741, Rue Saint-Denis, Montreal, QC H2X 3K4": "1741 Saint-Denis Street",
    "4873, Boul Saint-Laurent, Montreal, QC H2T 1R6": "4873 Saint-Laurent Boulevard",
    "6631Blvd St-Laurent, Montreal, QC H2S 3C5": "6631 St-Laurent Boulevard",
    "1748 Rue Notre-Dame O, Montreal, QC H3J 1N6": "1748 Notre-Dame Street West",
    "335 De Maisonneuve Boul E, Montreal, QC H2X 1K1, Canada": "335 De Maisonneuve Boulevard East",
    "5175A Avenue Du Parc, Montréal, QC H2V 4G4": "5175A Du Parc Avenue",
    "5195 rue Paré, Montreal, QC H4P 1P4": "5195 Paré Street",
    "291 Beaudoin Street, Montréal, QC H4C 2Y3": "291 Beaudoin Street",
    "6731 de L'esplanade, Montréal, QC H2V 4S9": "6731 De L'esplanade",
    "4005 Ontario E, Montréal, QC H1W": "4005 Ontario East",
    "148 Jean-Talon W Rue": "148 Jean-Talon W Street",
    "12 Rue Avenue Nord Sud": "12 Avenue South",
    "no number": None,
    "1234567 Rue X": None,
}


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame([(a,) for a in STANDARD] + [(None,)], "address_raw string")


def test_standard_addresses(addresses):
    rows = standardise_addresses(addresses).collect()
    got = {r.address_raw: r.address for r in rows}
    assert got == {**STANDARD, None: None}
    assert {r.address_raw for r in rows if r.address_error} == {"no number", "1234567 Rue X"}


def test_result_starts_with_number(addresses):
    wrong = standardise_addresses(addresses).filter(
        ~F.startswith("address", F.concat(A.house_number(F.col("address_raw")), F.lit(" ")))
    )
    assert wrong.count() == 0


def test_english_directions_as_an_option(spark):
    df = spark.createDataFrame([("148 Jean-Talon W Rue",)], "address_raw string")
    english = {**STREET_DIRECTIONS, "w": "west", "east": "east"}
    assert standardise_addresses(df, directions=english).first().address == "148 Jean-Talon Street West"


def test_punctuation_free_form_keeps_direction_only_with_type(spark):
    df = spark.createDataFrame([("St-Denis. Rue, E",), ("Ontario E",)], "s string")
    got = [r[0] for r in df.select(A.punctuation_free_address(F.col("s"))).collect()]
    assert got == ["St Denis Street East", "Ontario"]


def test_addresses_in_text(spark):
    text = "We are at 5308 Saint-Laurent Blvd, Montréal, QC; also 12 rue X, montreal QC."
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(A.addresses_in_text(F.col("s"))).first()[0] == [
        "5308 Saint-Laurent Blvd, Montréal, QC", "12 rue X, montreal QC.",
    ]
